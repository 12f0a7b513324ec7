"""Synthetic damage to images, for building bad examples.

Each operator is raster -> raster (uint8) at an intensity from 0 to 1. What is
random comes from a generator seeded by (path, operator, seed), so results
don't depend on partitions or order.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import shrink

Damage = Callable[[np.ndarray, float, np.random.Generator], np.ndarray]


def _clip(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8)


def _planes(a: np.ndarray) -> np.ndarray:
    return a[..., None] if a.ndim == 2 else a


def _box(a: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Mean of 2 * reach + 1 pixels along an axis, edges extended."""
    if reach < 1:
        return a.astype(float)
    pad = [(0, 0)] * a.ndim
    pad[axis] = (reach + 1, reach)
    c = np.cumsum(np.pad(a.astype(float), pad, mode="edge"), axis=axis)
    n = 2 * reach + 1
    take = lambda lo: np.take(c, np.arange(lo, lo + a.shape[axis]), axis=axis)
    return (take(n) - take(0)) / n


def _sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float = 255) -> np.ndarray:
    """Bilinear values at (y, x); ``fill`` outside."""
    h, w = a.shape[:2]
    p = _planes(a).astype(float)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    out[(y < 0) | (y > h - 1) | (x < 0) | (x > w - 1)] = fill
    return _clip(out).reshape(a.shape)


def _grid(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = a.shape[:2]
    return np.meshgrid(np.linspace(0, 1, h), np.linspace(0, 1, w), indexing="ij")


def _times(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return _clip(a * (mask if a.ndim == 2 else mask[..., None]))


def blur(a, k, r):
    reach = max(1, int(1 + 4 * k))
    return _clip(_box(_box(_box(_box(a, reach, 0), reach, 1), reach, 0), reach, 1))


def darken(a, k, r):
    return _clip(a * (1 - 0.3 - 0.5 * k))


def lighten(a, k, r):
    return _clip(a * (1 + 0.3 + 0.7 * k) + 40 * k)


def low_contrast(a, k, r):
    return _clip(128 + (a.astype(float) - 128) * (0.5 - 0.35 * k))


def add_noise(a, k, r):
    return _clip(a + r.normal(0, 20 + 60 * k, a.shape))


def crush(a, k, r):
    """Blocks of 8 pixels flattened towards their mean, as strong compression does."""
    p = _planes(a).astype(float)
    h, w = p.shape[0] // 8 * 8, p.shape[1] // 8 * 8
    if h and w:
        b = p[:h, :w].reshape(h // 8, 8, w // 8, 8, -1)
        p[:h, :w] = (b * (0.4 - 0.4 * k) + b.mean(axis=(1, 3), keepdims=True) * (0.6 + 0.4 * k)).reshape(h, w, -1)
    return _clip(p).reshape(a.shape)


def reduce_size(a, k, r):
    return _clip(shrink(a, max(8, int(max(a.shape[:2]) * (0.5 - 0.35 * k)))))


def skew(a, k, r):
    angle = np.radians((4 + 12 * k) * r.choice([-1, 1]))
    h, w = a.shape[:2]
    y, x = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
    return _sample(a, np.cos(angle) * y - np.sin(angle) * x + h / 2, np.sin(angle) * y + np.cos(angle) * x + w / 2)


def add_shadow(a, k, r):
    y, x = _grid(a)
    side = [x, 1 - x, y, 1 - y][r.integers(4)]
    return _times(a, 1 - (0.4 + 0.45 * k) * np.clip(1 - side / 0.45, 0, 1))


def add_dust(a, k, r):
    out, (h, w) = a.copy(), a.shape[:2]
    for _ in range(int(20 + 180 * k)):
        y, x, s = r.integers(h), r.integers(w), r.integers(1, 4)
        out[y : y + s, x : x + s] = r.integers(0, 80)
    return out


def desaturate(a, k, r):
    if a.ndim == 2:
        return a
    grey = a.astype(float).mean(axis=2, keepdims=True)
    return _clip(a * (1 - k) + grey * k)


def motion_blur(a, k, r):
    return _clip(_box(a, int(4 + 16 * k), int(r.integers(2))))


def perspective_tilt(a, k, r):
    h, w = a.shape[:2]
    y, x = _grid(a)
    squeeze = 1 - (0.15 + 0.25 * k) * (1 - y)
    return _sample(a, y * (h - 1), ((x - 0.5) / squeeze + 0.5) * (w - 1))


def glare(a, k, r):
    y, x = _grid(a)
    d = np.hypot(y - r.uniform(0.25, 0.75), x - r.uniform(0.25, 0.75)) / (0.15 + 0.2 * k)
    light = np.clip(1 - d, 0, 1)[..., None] * 255
    return _clip(_planes(a) + light).reshape(a.shape)


def partial_crop(a, k, r):
    h, w = a.shape[:2]
    y, x = int(h * (0.1 + 0.25 * k)), int(w * (0.1 + 0.25 * k))
    top, left = r.integers(0, y + 1), r.integers(0, x + 1)
    return np.ascontiguousarray(a[top : max(top + 1, h - y + top), left : max(left + 1, w - x + left)])


def uneven_lighting(a, k, r):
    y, x = _grid(a)
    turn = r.uniform(0, 2 * np.pi)
    slope = (np.cos(turn) * (x - 0.5) + np.sin(turn) * (y - 0.5)) * 1.4
    return _times(a, 1 - (0.35 + 0.4 * k) * np.clip(0.5 + slope, 0, 1))


def moire(a, k, r):
    h, w = a.shape[:2]
    y, x = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    waves = np.sin(2 * np.pi * x / r.uniform(2.5, 5)) + np.sin(2 * np.pi * (x + y) / r.uniform(2.5, 5))
    return _clip(_planes(a) + ((10 + 25 * k) * waves)[..., None]).reshape(a.shape)


#: Names as they are marked in the paths of damaged files.
DAMAGES: dict[str, Damage] = {
    "blur": blur, "darken": darken, "lighten": lighten, "lowContrast": low_contrast, "addNoise": add_noise, "crush": crush, "shrink": reduce_size, "skew": skew,
    "addShadow": add_shadow, "addDust": add_dust, "desaturate": desaturate, "motionBlur": motion_blur, "perspectiveTilt": perspective_tilt, "glare": glare,
    "partialCrop": partial_crop, "unevenLighting": uneven_lighting, "moire": moire,
}


def generator(path: str, name: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(f"{path}|{name}|{seed}".encode()))


def degrade(images: DataFrame, names: list[str], intensity: float = 0.5, seed: int = 42) -> DataFrame:
    """Rasters (path, width, height, n_channels, data) after the named damages in order.

    A row whose data doesn't fit its size comes through unchanged.
    """
    kind = "width int, height int, n_channels int, data binary"

    @F.pandas_udf(kind)
    def run(path: pd.Series, width: pd.Series, height: pd.Series, n: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, h, c, raw in zip(path, width, height, n, data, strict=True):
            if raw is None or len(raw) != w * h * c:
                out.append((w, h, c, raw))
                continue
            a = np.frombuffer(raw, dtype=np.uint8).reshape((h, w) if c == 1 else (h, w, c))
            for name in names:
                a = DAMAGES[name](a, intensity, generator(p or "", name, seed))
            out.append((a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], a.tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "n_channels", "data"])

    cols = ["width", "height", "n_channels", "data"]
    return images.withColumn("_d", run("path", *cols)).withColumns({c: F.col(f"_d.{c}") for c in cols}).drop("_d")


def plan_damages(paths: DataFrame, seed: int = 42) -> DataFrame:
    """(path, damages, tier): one or two damages for each path; 65 in 100 become bad, the rest very-bad."""
    names = F.array(*[F.lit(n) for n in DAMAGES])
    draw = lambda salt, n: F.pmod(F.xxhash64("path", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    n = len(DAMAGES)
    first = draw(1, n)
    second = F.pmod(first + 1 + draw(2, n - 1), F.lit(n))
    bad = draw(3, 100) < 65
    return paths.select("path").filter("path is not null").distinct().select("path", F.when(bad, F.array(names[first])).otherwise(F.array(names[first], names[second])).alias("damages"), F.when(bad, "bad").otherwise("very-bad").alias("tier"))
