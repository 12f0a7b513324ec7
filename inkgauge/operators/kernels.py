"""Raster kernels: numpy on one image at a time, in Arrow batches.

A raster leaves a kernel only as a row of metrics. Everything is whole-array
numpy; regions are slices, bins are bincounts, labels are joined run by run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import PREFLIGHT, THRESHOLDS

SPECTRUM_SIDE, SPECTRUM_LEAST = 512, 32
MAX_RUNS, MAX_PARTS, LEAST_PARTS = 50_000, 5_000, 20


def round_up(x: float) -> int:
    return math.floor(x + 0.5)


# ── rasters ──────────────────────────────────────────────────────────────────
def on_white(rgba: np.ndarray) -> np.ndarray:
    """Colour over white where there is an alpha channel; whole numbers throughout, half up."""
    if rgba.ndim == 3 and rgba.shape[2] in (2, 4):
        a = rgba[..., -1:].astype(np.int32)
        return ((rgba[..., :-1] * (2 * a) + (510 * (255 - a) + 255)) // 510).astype(np.uint8)
    return rgba


_RED, _GREEN, _BLUE = (np.arange(256) * k for k in (0.2989, 0.5870, 0.1140))


def to_grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[..., 0]
    tone = _RED[image[..., 0]]
    tone += _GREEN[image[..., 1]]
    tone += _BLUE[image[..., 2]]
    tone += 0.5
    return tone.astype(np.uint8)


@lru_cache(maxsize=64)
def _cover(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """First source cell of each target cell, and the shares of it and the cells behind it (rows of the array)."""
    step = source / target
    left = np.arange(target) * step
    right = np.minimum(left + step, source)
    first = np.floor(left).astype(np.int64)
    at = first + np.arange(int((np.ceil(right) - first).max()))[:, None]
    share = np.clip(np.minimum(at + 1, right) - np.maximum(at, left), 0, None)
    return first, (share / share.sum(axis=0)).astype(np.float32)


def _squeeze(a: np.ndarray, first: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weighted sums of neighbouring rows of a 2-d array: one row per entry of ``first``."""
    out = a[first] * share[0][:, None]
    for k in range(1, len(share)):
        out += a[np.minimum(first + k, len(a) - 1)] * share[k][:, None]
    return out


def shrink(image: np.ndarray, side: int) -> np.ndarray:
    """Area average to at most ``side`` on the longer axis, never enlarged.

    Each pixel is read about once, in strips of rows small enough for the
    processor's cache, so the work follows the pixels and not their square.
    """
    h, w = image.shape[:2]
    scale = side / max(h, w)
    if scale >= 1:
        return image.astype(float)
    c = 1 if image.ndim == 2 else image.shape[2]
    nh, nw = max(1, round_up(h * scale)), max(1, round_up(w * scale))
    (top, down), (left, across) = _cover(h, nh), _cover(w, nw)
    flat, out = image.reshape(h, w * c), np.empty((nh, nw, c), dtype=np.float32)
    strip = max(1, 250_000 // (w * c))
    for y in range(0, nh, strip):
        rows = _squeeze(flat, top[y : y + strip], down[:, y : y + strip])
        n = len(rows)
        turned = np.ascontiguousarray(rows.reshape(n, w, c).transpose(1, 0, 2)).reshape(w, n * c)
        out[y : y + n] = _squeeze(turned, left, across).reshape(nw, n, c).transpose(1, 0, 2)
    return out[..., 0] if image.ndim == 2 else out


def rounded(raster: np.ndarray) -> np.ndarray:
    return (raster + 0.5).astype(np.uint8)


def laplacian(grey: np.ndarray) -> np.ndarray:
    """8 times the pixel minus its neighbours, in 0..255, edges extended."""
    p = np.pad(grey, 1, mode="edge").astype(np.int16)
    rows = p[:-2] + p[1:-1]
    rows += p[2:]
    out = p[1:-1, 1:-1] * 9
    for part in (rows[:, :-2], rows[:, 1:-1], rows[:, 2:]):
        out -= part
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


# ── spectrum ─────────────────────────────────────────────────────────────────
@lru_cache(maxsize=16)
def _frequencies(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Radius and angle of every bin; 1 is the highest frequency along an axis."""
    y, x = (np.minimum(np.arange(n), n - np.arange(n)) / (n >> 1) for n in shape)
    return np.hypot(x[None, :], y[:, None]), np.arctan2(y[:, None], x[None, :])


@lru_cache(maxsize=16)
def _rings(shape: tuple[int, int]) -> list[np.ndarray]:
    """Places of the bins of ten rings; the innermost bins are in none."""
    r = _frequencies(shape)[0].ravel()
    ring = np.where(r >= 0.05, np.minimum((r * 10).astype(int), 9), 10)
    order = np.argsort(ring, kind="stable")
    return np.split(order, np.searchsorted(ring[order], np.arange(1, 11)))[:10]


@lru_cache(maxsize=16)
def _sectors(shape: tuple[int, int]) -> np.ndarray:
    """Sector of every bin; 12 for those near the middle."""
    r, angle = _frequencies(shape)
    return np.where(r >= 0.05, np.minimum((angle / math.pi * 12).astype(int), 11), 12).ravel()


@dataclass
class Spectrum:
    power: np.ndarray
    energy: float

    def radius(self) -> np.ndarray:
        return _frequencies(self.power.shape)[0]

    def angle(self) -> np.ndarray:
        return _frequencies(self.power.shape)[1]


def fft1d(values: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of a row whose length is a power of two; the inverse scales by 1/n."""
    n = len(values)
    if n < 1 or n & (n - 1):
        raise ValueError("the length must be a power of two")
    return np.fft.ifft(values) if inverse else np.fft.fft(values)


def spectrum(grey: np.ndarray, side: int | None = SPECTRUM_SIDE) -> Spectrum | None:
    """Power of the mean-free, Hann-windowed, zero-padded raster; None below 32 pixels."""
    g = shrink(grey, side) if side else grey.astype(float)
    if min(g.shape) < SPECTRUM_LEAST:
        return None
    g = (g - g.mean(dtype=float)) * np.hanning(g.shape[0])[:, None] * np.hanning(g.shape[1])[None, :]
    h, w = (1 << (n - 1).bit_length() for n in g.shape)
    half = np.fft.rfft2(g, (h, w))
    half = half.real**2 + half.imag**2  # the other half mirrors it
    power = np.empty((h, w))
    power[:, : w // 2 + 1] = half
    power[:, w // 2 + 1 :] = half[-np.arange(h) % h, w // 2 - 1 : 0 : -1]
    return Spectrum(power, float(power.sum()))


def high_frequency(s: Spectrum, beyond: float = 0.3) -> float:
    return float(s.power[s.radius() > beyond].sum() / s.energy) if s.energy > 0 else 0.0


def spectral_peaks(s: Spectrum, times: float = 6.0) -> int:
    """Bins above ``times`` the median of their ring (ten rings, the middle left out)."""
    if s.energy <= 0:
        return 0
    size = np.sqrt(s.power).ravel()
    floor, count = math.sqrt(s.energy / s.power.size) * 0.01, 0
    for ring in _rings(s.power.shape):
        if len(ring) >= 3:
            v = size[ring]
            count += int((v > max(float(np.median(v)), floor) * times).sum())
    return count


def directional_ratio(s: Spectrum) -> float | None:
    """Largest over median energy of twelve sectors. Angles are folded into a
    quarter turn over half a turn's sectors, so five of them stay empty."""
    energy = np.bincount(_sectors(s.power.shape), weights=s.power.ravel(), minlength=13)[:12]
    middle = float(np.median(energy))
    return float(energy.max()) / middle if middle > 0 else None


def blockiness(grey: np.ndarray) -> float:
    """How much steeper gradients are on the 8-pixel grid than off it."""
    if min(grey.shape) < 16:
        return 0.0
    h, w = grey.shape
    step = lambda a, b: np.maximum(a, b) - np.minimum(a, b)
    dx, dy = step(grey[:, 1:], grey[:, :-1]).sum(axis=0, dtype=np.int64), step(grey[1:], grey[:-1]).sum(axis=1, dtype=np.int64)
    on, n_on = int(dx[7::8].sum() + dy[7::8].sum()), len(dx[7::8]) * h + len(dy[7::8]) * w
    off, n_off = int(dx.sum() + dy.sum()) - on, len(dx) * h + len(dy) * w - n_on
    if not n_on or not n_off:
        return 0.0
    a, b = on / n_on, off / n_off
    return (10.0 if a > 0.5 else 0.0) if b < 0.1 else max(0.0, a / b - 1)


# ── text geometry ────────────────────────────────────────────────────────────
def _runs(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column (exclusive) of every horizontal run of dark pixels."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, start = np.nonzero(edge == 1)
    return rows, start, np.nonzero(edge == -1)[1]


def components(dark: np.ndarray) -> dict[str, np.ndarray] | None:
    """Eight-connected parts in scan order of their first pixel: area, centre,
    box, outline pixels. None when more than MAX_RUNS parts would be begun.

    Runs are the nodes; two runs of neighbouring rows touch when they overlap
    or meet at a corner. Labels fall to the smallest by doubling.
    """
    rows, start, stop = _runs(dark)
    n = len(rows)
    h, w = dark.shape
    if n:
        first = np.searchsorted(rows, np.arange(h + 1))
        key_start, key_stop = rows * (w + 2) + start, rows * (w + 2) + stop
        above = (rows - 1) * (w + 2)
        lo = np.searchsorted(key_stop, above + start, "left")  # runs above that end at or after my start
        hi = np.searchsorted(key_start, above + stop, "right")  # and start at or before my end
        lo, hi = np.maximum(lo, first[np.maximum(rows - 1, 0)]), np.minimum(hi, first[rows])
        hi = np.where(rows > 0, np.maximum(hi, lo), lo)
        degree = hi - lo
        if int((degree == 0).sum()) > MAX_RUNS:
            return None
        mine = np.repeat(np.arange(n), degree)
        other = np.repeat(lo - np.r_[0, np.cumsum(degree)[:-1]], degree) + np.arange(degree.sum())
        label = np.arange(n)
        while True:
            low = np.minimum(label[mine], label[other])
            new = label.copy()
            np.minimum.at(new, label[mine], low)
            np.minimum.at(new, label[other], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        while (label[label] != label).any():
            label = label[label]
        _, part = np.unique(label, return_inverse=True)
    else:
        part = np.zeros(0, dtype=int)
    count = int(part.max()) + 1 if n else 0
    length = stop - start
    inner = np.pad(dark, 1)
    outline = dark & ~(inner[:-2, 1:-1] & inner[2:, 1:-1] & inner[1:-1, :-2] & inner[1:-1, 2:])
    along = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(outline.ravel(), dtype=np.int64)])
    add = lambda v: np.bincount(part, weights=v, minlength=count)
    if not n:
        return dict.fromkeys(("area", "cx", "cy", "min_x", "max_x", "min_y", "max_y", "perimeter"), np.zeros(0))
    area = add(length)
    low_x, high_x, low_y, high_y = np.full(count, w), np.zeros(count, int), np.full(count, h), np.zeros(count, int)
    np.minimum.at(low_x, part, start), np.maximum.at(high_x, part, stop - 1)
    np.minimum.at(low_y, part, rows), np.maximum.at(high_y, part, rows)
    return {
        "area": area, "cx": add((start + stop - 1) * length / 2) / area, "cy": add(rows * length) / area,
        "min_x": low_x, "max_x": high_x, "min_y": low_y, "max_y": high_y, "perimeter": add(along[rows * w + stop] - along[rows * w + start]),
    }


def text_geometry(grey: np.ndarray, dark_below: float = THRESHOLDS["binarizationThreshold"]) -> tuple[float, float, float] | None:
    """(baseline deviation, size variation, shape variation); None below 100 x 100, zeros without enough letters."""
    h, w = grey.shape
    if h < 100 or w < 100:
        return None
    parts = components(grey < dark_below)
    if parts is None:
        return 0.0, 0.0, 0.0
    area = parts["area"]
    aspect = (parts["max_x"] - parts["min_x"] + 1) / np.maximum(1, parts["max_y"] - parts["min_y"] + 1)
    keep = np.flatnonzero((area >= max(h * w * 1e-6, 4)) & (area <= h * w * 0.01) & (aspect >= 0.1) & (aspect <= 10))
    if len(keep) > MAX_PARTS:
        keep = keep[np.argsort(-area[keep], kind="stable")[:MAX_PARTS]]
    if len(keep) < LEAST_PARTS:
        return 0.0, 0.0, 0.0
    keep = keep[_dominant(area[keep])]
    if len(keep) < LEAST_PARTS:
        return 0.0, 0.0, 0.0
    a, cx, cy, outline = area[keep], parts["cx"][keep], parts["cy"][keep], parts["perimeter"][keep]
    order = np.argsort(cy, kind="stable")
    cx, cy = cx[order], cy[order]
    gap = max(1.5 * math.sqrt(np.sort(a)[len(a) >> 1]), 1)
    row = np.cumsum(np.r_[0, np.diff(cy) > gap])
    residuals = []
    for k in range(int(row[-1]) + 1):
        x, y = cx[row == k], cy[row == k]
        spread = len(x) * float(x @ x) - float(x.sum()) ** 2
        if len(x) < 5 or abs(spread) < 1e-10:
            continue
        slope = (len(x) * float(x @ y) - float(x.sum()) * float(y.sum())) / spread
        residuals.append(math.sqrt(float(((y - y.mean() - slope * (x - x.mean())) ** 2).mean())))
    round_ = 4 * math.pi * a[outline > 0] / outline[outline > 0] ** 2
    variation = lambda v: float(v.std() / v.mean()) if len(v) and v.mean() > 0 else 0.0
    return (float(np.mean(residuals)) / h if residuals else 0.0), variation(a), variation(round_) if len(round_) >= LEAST_PARTS else 0.0


def _dominant(area: np.ndarray) -> np.ndarray:
    """Parts within a factor two of the commonest size (bins of about one octave)."""
    log = np.log2(area)
    low, span = log.min(), log.max() - log.min()
    if span < 0.01:
        return np.ones(len(area), dtype=bool)
    bins = max(1, math.ceil(span))
    step = span / bins
    mode = int(np.argmax(np.bincount(np.minimum(((log - low) / step).astype(int), bins), minlength=bins + 1)))
    middle = 2 ** (low + (mode + 0.5) * step)
    return (area >= middle / 2) & (area <= middle * 2)


# ── document bounds ──────────────────────────────────────────────────────────
def document_bounds(image: np.ndarray, size: tuple[int, int] | None = None) -> dict[str, int] | None:
    """The bright page on a dark ground, or None where there is no clear one.

    Fifteen rays from each side look for a rise from dark to bright in the
    outer fifth of a 200-pixel thumbnail. ``image`` may have been shrunk
    already; the region is told in pixels of ``size`` (height, width).
    """
    grey = to_grey(on_white(image))
    h0, w0 = size or grey.shape
    g = np.floor(shrink(grey, 200) + 0.5)
    h, w = g.shape
    if min(h, w) < 10 or not 40 <= g.mean() <= 200 or g.std() < 15:
        return None
    across_x = [min(round_up((r + 0.5) / 15 * w), w - 1) for r in range(15)]
    across_y = [min(round_up((r + 0.5) / 15 * h), h - 1) for r in range(15)]
    dy, dx = int(h * 0.2), int(w * 0.2)
    top = _rise(g[:dy, across_x].T, h)
    bottom = _rise(g[::-1][:dy, across_x].T, h)
    left = _rise(g[across_y, :dx], w)
    right = _rise(g[:, ::-1][across_y, :dx], w)
    if sum(e is not None for e in (top, bottom, left, right)) < 2:
        return None
    inset = [0 if e is None else e for e in (top, bottom, left, right)]
    if inset[0] > h / 4 or inset[1] > h / 4 or inset[2] > w / 4 or inset[3] > w / 4:
        return None
    y0, y1, x0, x1 = inset[0], h - inset[1], inset[2], w - inset[3]
    if x1 - x0 < 0.4 * w or y1 - y0 < 0.4 * h or not 0.15 <= (x1 - x0) / (y1 - y0) <= 6.5:
        return None
    inside = np.zeros((h, w), dtype=bool)
    inside[y0:y1, x0:x1] = True
    if inside.all() or g[inside].mean() - g[~inside].mean() < 25:
        return None
    x, y = min(round_up(x0 * w0 / w), w0 - 1), min(round_up(y0 * h0 / h), h0 - 1)
    bw, bh = min(round_up((x1 - x0) * w0 / w), w0 - x), min(round_up((y1 - y0) * h0 / h), h0 - y)
    return {"x": x, "y": y, "width": bw, "height": bh} if bw > 0 and bh > 0 else None


def _rise(rays: np.ndarray, extent: int) -> int | None:
    """Least inset of the rises on the rays; None unless ten rays have one and they lie close."""
    if rays.shape[1] < 4:
        return None
    s = rays.astype(float).copy()
    s[:, 1:-1] = (rays[:, :-2] + rays[:, 1:-1] + rays[:, 2:]) / 3
    now, back = s[:, 3:], s[:, :-3]
    dark = np.minimum(np.minimum(s[:, :-3], s[:, 1:-2]), s[:, 2:-1]) < 120
    hit = (now >= 160) & dark & (now - back >= 25)
    at = hit.argmax(axis=1)[hit.any(axis=1)] + 3
    if len(at) < 10 or at.max() - at.min() > extent / 4:
        return None
    return int(at.min())


# ── metric rows ──────────────────────────────────────────────────────────────
@dataclass(frozen=True)
class Limits:
    """Thresholds that metrics themselves depend on."""

    longest: int = int(THRESHOLDS["analysisMaxPx"])
    edge: float = THRESHOLDS["laplacianEdgeThreshold"]
    dark: float = THRESHOLDS["binarizationThreshold"]

    @classmethod
    def of(cls, overrides: dict[str, float] | None) -> Limits:
        t = THRESHOLDS | (overrides or {})
        return cls(max(1, int(t["analysisMaxPx"])), float(t["laplacianEdgeThreshold"]), float(t["binarizationThreshold"]))


_TONES = np.arange(256, dtype=np.int64)


def _histogram(raster: np.ndarray) -> np.ndarray:
    return np.bincount(raster.ravel(), minlength=256)


def _moments(counts: np.ndarray) -> tuple[int, float, float]:
    """Number, mean and population variance of counted grey levels; the sums are whole numbers."""
    n, total = int(counts.sum()), int(counts @ _TONES)
    return n, total / n, int(counts @ (_TONES * _TONES)) / n - (total / n) ** 2


def _share(counts: np.ndarray, which: np.ndarray) -> float:
    return float(counts[which].sum() / counts.sum())


def fast_metrics(image: np.ndarray, limits: Limits = Limits(), keep: dict | None = None) -> dict[str, float]:
    """Channel and Laplacian metrics of a decoded image (grey or colour, uint8).

    All come from histograms of 256 levels. ``keep`` gets the rasters and the
    histograms by quarter that the other metrics go on with.
    """
    flat = on_white(image)
    grey = to_grey(flat)
    lap = laplacian(grey)
    h, w = grey.shape
    y, x = h // 2, w // 2
    zones = [(slice(0, y), slice(0, x)), (slice(0, y), slice(x, w)), (slice(y, h), slice(0, x)), (slice(y, h), slice(x, w))]
    lap_parts, grey_parts = np.array([_histogram(lap[z]) for z in zones]), np.array([_histogram(grey[z]) for z in zones]) if keep is not None or flat.ndim == 2 else None
    counts = [grey_parts.sum(axis=0)] if flat.ndim == 2 else [_histogram(flat[..., c]) for c in range(flat.shape[2])]
    spread = []
    for c in counts:
        n, _, v = _moments(c)
        spread.append(math.sqrt(max(0.0, v) * n / max(1, n - 1)))
    lap_all = lap_parts.sum(axis=0)
    _, mean, variance = _moments(lap_all)
    if keep is not None:
        keep |= {"flat": flat, "grey": grey, "lap": lap, "grey_parts": grey_parts, "lap_parts": lap_parts, "means": [_moments(c)[1] for c in counts]}
    return {
        "brightnessAvg": sum(_moments(c)[1] for c in counts) / len(counts), "brightnessStdevMax": max(spread),
        "laplacianMean": mean, "laplacianVariance": variance, "laplacianStdev": math.sqrt(max(0.0, variance)),
        "edgeRatio": _share(lap_all, _TONES > limits.edge), "channelCount": float(1 if image.ndim == 2 else image.shape[2]),
    }


def skew_angle(lap: np.ndarray, edge: float = THRESHOLDS["laplacianEdgeThreshold"]) -> float | None:
    """Degrees of the line through the centres of mass of edge pixels in 20 strips."""
    h, w = lap.shape
    if h < 20 or w < 20:
        return None
    wide = w // 20
    strips = np.add.reduceat((lap * (lap > edge))[:, : 20 * wide], np.arange(20) * wide, axis=1, dtype=np.int64)
    weight = strips.sum(axis=0)
    some = weight > 0
    if some.sum() < 3:
        return None
    y = (np.arange(h) @ strips)[some] / weight[some]
    x = (np.arange(20) * wide + wide / 2)[some]
    spread = len(x) * float(x @ x) - float(x.sum()) ** 2
    if abs(spread) < 1e-10:
        return None
    return abs(math.degrees(math.atan((len(x) * float(x @ y) - float(x.sum()) * float(y.sum())) / spread)))


def thorough_metrics(image: np.ndarray, is_jpeg: bool = False, keep: dict | None = None, limits: Limits = Limits()) -> dict[str, float | None]:
    """All raster metrics; those that need a larger image are None. ``keep`` gets the grey raster and the spectrum."""
    seen: dict = {}
    out: dict[str, float | None] = fast_metrics(image, limits, seen)
    flat, grey, lap, tones, steps = (seen[k] for k in ("flat", "grey", "lap", "grey_parts", "lap_parts"))
    h, w = grey.shape
    whole = tones.sum(axis=0)
    out["foregroundRatio"] = _share(whole, _TONES < limits.dark)
    if h > 20:
        spread = [_moments(steps[i : i + 2].sum(axis=0))[2] for i in (0, 2)]
        out["sharpnessRatioTopBot"] = max(spread) / min(spread) if min(spread) > 5 else None
        out["brightnessDiffTopBot"] = abs(_moments(tones[:2].sum(axis=0))[1] - _moments(tones[2:].sum(axis=0))[1])
    if h >= 20 and w >= 20:
        strip = max(1, int(min(h, w) * 0.1))
        total, middle = int(whole @ _TONES), grey[strip : h - strip, strip : w - strip]
        edge = (total - int(middle.sum())) / (grey.size - middle.size)
        centre = float(grey[int(h * 0.3) : int(h * 0.7), int(w * 0.3) : int(w * 0.7)].mean())
        out |= {"shadowEdgeCenterDiff": centre - edge, "centerBrightness": centre, "edgeBrightness": edge, "skewAngle": skew_angle(lap, limits.edge)}
        out["backgroundP90"] = float(np.argmax(np.cumsum(whole) >= math.floor(grey.size * 0.9)))
    if flat.ndim == 3 and flat.shape[2] >= 3:
        out["colorSaturation"] = (max(seen["means"][:3]) - min(seen["means"][:3])) / 255
    s = spectrum(grey)
    if keep is not None:
        keep |= {"grey": grey, "spectrum": s}
    if s is not None:
        out |= {"fftHighFreqRatio": high_frequency(s), "fftSpectralPeaks": float(spectral_peaks(s)), "directionalEnergyRatio": directional_ratio(s)}
    if is_jpeg:
        out["fftJpegBlockiness"] = blockiness(grey)
    if h >= 100 and w >= 100:
        bright = [_moments(c)[1] for c in tones]
        sharp = [math.sqrt(max(0.0, _moments(c)[2])) for c in steps]
        out |= {f"zoneBrightness{i}": b for i, b in enumerate(bright)} | {f"zoneSharpness{i}": v for i, v in enumerate(sharp)}
        out |= {"zoneBrightnessDiff": max(bright) - min(bright), "zoneSharpnessRatio": min(sharp) / max(sharp) if max(sharp) > 0 else 1.0}
        out |= dict(zip(("textBaselineDeviation", "textCharSizeCV", "textCharShapeCV"), text_geometry(grey, limits.dark), strict=True))
    return out


def preflight_metrics(image: np.ndarray, side: int = 200, edge: float = PREFLIGHT["laplacianEdgeThreshold"], dark: float = PREFLIGHT["binarizationThreshold"]) -> dict[str, float | None]:
    """Metrics of the quick check on a thumbnail; the Laplacian's border is left out."""
    small = rounded(shrink(on_white(image), side))
    grey = to_grey(small)
    parts = [_moments(_histogram(c)) for c in ([small] if small.ndim == 2 else np.moveaxis(small, 2, 0))]
    out: dict[str, float | None] = {"brightnessAvg": sum(m for _, m, _ in parts) / len(parts), "foregroundRatio": float((grey < dark).mean())}
    out["brightnessStdevMax"] = out["blankStdevMax"] = max(math.sqrt(max(0.0, v)) for _, _, v in parts)
    inner = laplacian(grey)[1:-1, 1:-1]
    if inner.size:
        out |= {"laplacianStdev": float(inner.std()), "edgeRatio": float((inner > edge).mean())}
    return out


RASTER_METRICS = [
    "brightnessAvg", "brightnessStdevMax", "laplacianStdev", "laplacianMean", "laplacianVariance", "edgeRatio", "foregroundRatio", "sharpnessRatioTopBot",
    "brightnessDiffTopBot", "shadowEdgeCenterDiff", "centerBrightness", "edgeBrightness", "backgroundP90", "skewAngle", "colorSaturation", "fftHighFreqRatio",
    "fftSpectralPeaks", "fftJpegBlockiness", "zoneBrightnessDiff", "zoneSharpnessRatio", "directionalEnergyRatio", "zoneBrightness0", "zoneBrightness1",
    "zoneBrightness2", "zoneBrightness3", "zoneSharpness0", "zoneSharpness1", "zoneSharpness2", "zoneSharpness3", "channelCount", "textBaselineDeviation",
    "textCharSizeCV", "textCharShapeCV",
]
Plugin = Callable[[np.ndarray, Spectrum | None], float | None]
#: Reads the words of a raster: their confidences from 0 to 100.
Reader = Callable[[np.ndarray], list[float]]
OCR_METRICS = ["ocrMedianConfidence", "ocrWords"]


_REGION = pa.struct([(k, pa.float64()) for k in ("x", "y", "width", "height")])
_BOUNDARY = pa.struct([("detected", pa.bool_()), ("region", _REGION), ("confidence", pa.float64())])
BOUNDARY = "struct<detected:boolean,region:struct<x:double,y:double,width:double,height:double>,confidence:double>"


def _boundary(image: np.ndarray | None, size: tuple[int, int] | None = None) -> dict:
    """Result row of the page search; an error counts as none found."""
    try:
        found = None if image is None else document_bounds(image, size)
    except Exception:
        found = None
    return {"detected": found is not None, "region": found and {k: float(v) for k, v in found.items()}, "confidence": 1.0 if found else None}


def rasters(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The rasters of a batch's rows without copying them; None where data and size don't fit."""
    data = batch.column("data")
    sizes = zip(*(batch.column(n).to_pylist() for n in ("width", "height", "n_channels")), strict=True)
    for i, (w, h, c) in enumerate(sizes):
        raw = data[i].as_buffer() if data[i].is_valid else None
        fits = raw is not None and w and h and c and w > 0 and h > 0 and len(raw) == w * h * c
        yield np.frombuffer(raw, dtype=np.uint8).reshape((h, w) if c == 1 else (h, w, c)) if fits else None


def _cut(image: np.ndarray, boundary: dict | None) -> np.ndarray:
    """The region of a detected page, at least one pixel of the image; all of it where none is told."""
    r = boundary and boundary.get("detected") and boundary.get("region")
    if not r or any(r.get(k) is None for k in ("x", "y", "width", "height")):
        return image
    h, w = image.shape[:2]
    x, y = min(max(0, int(r["x"])), w - 1), min(max(0, int(r["y"])), h - 1)
    return np.ascontiguousarray(image[y : y + max(1, int(r["height"])), x : x + max(1, int(r["width"]))])


def raster_metrics(
    images: DataFrame, mode: str = "thorough", overrides: dict[str, float] | None = None, plugins: dict[str, Plugin] | None = None, find_page: bool = False, crop: bool = False, reader: Reader | None = None,
) -> DataFrame:
    """Metric columns added to rows of (width, height, n_channels, data, …); ``data`` leaves.

    ``data`` holds width * height * n_channels bytes, row by row. One narrow
    stage. Metrics follow the image shrunk to the threshold analysisMaxPx; that
    and the thresholds of edges and dark pixels may be in ``overrides``.
    Plugins are user functions (grey, spectrum) -> number, one column each, of
    the thorough mode; an error in one gives null there and nothing else.
    ``find_page`` adds ``boundary`` in the same pass, from the same shrunk
    raster. ``crop`` analyses only the region of the rows' own ``boundary``,
    whose size the row then has. ``reader`` gives the confidences of a
    raster's words: OCR_METRICS, null for fewer than five words. A row whose
    data doesn't fit its size gets null metrics and the reason in ``error``.
    Without a column ``format`` the block metric is taken of every image.
    """
    plugins = plugins if plugins and mode == "thorough" else {}
    limits = Limits.of(overrides)
    names = RASTER_METRICS + list(plugins) + (OCR_METRICS if reader else [])
    keep = [f for f in images.schema.fields if f.name != "data" and f.name not in (*names, "error")]
    extra = [T.StructField("boundary", T._parse_datatype_string(BOUNDARY))] if find_page else []
    keep = [f for f in keep if not (find_page and f.name == "boundary")]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("error", T.StringType()), *extra])

    def one(whole: np.ndarray, jpeg: bool, row: dict) -> None:
        image = on_white(whole)
        image = rounded(shrink(image, limits.longest)) if max(image.shape[:2]) > limits.longest else image
        seen: dict = {}
        row |= thorough_metrics(image, jpeg, seen, limits) if mode == "thorough" else fast_metrics(image, limits)
        row["channelCount"] = float(whole.shape[2] if whole.ndim == 3 else 1)  # alpha counts
        for name, f in plugins.items():
            try:
                row[name] = float(f(seen["grey"], seen["spectrum"]))
            except Exception:
                row[name] = None
        if reader:
            words = list(reader(image))
            row["ocrWords"] = float(len(words))
            row["ocrMedianConfidence"] = float(np.median(words)) if len(words) >= 5 else None
        if find_page:
            row["boundary"] = _boundary(image, whole.shape[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[dict] = []
            has = set(batch.schema.names)
            formats = batch.column("format").to_pylist() if "format" in has else ["jpeg"] * batch.num_rows
            own = batch.column("boundary").to_pylist() if crop and "boundary" in has else [None] * batch.num_rows
            for whole, kind, found in zip(rasters(batch), formats, own, strict=True):
                row: dict = {"error": None, "boundary": {"detected": False, "region": None, "confidence": None}}
                if whole is None:
                    row["error"] = "raster doesn't fit its size"
                else:
                    try:
                        whole = _cut(whole, found)
                        row |= {"width": whole.shape[1], "height": whole.shape[0]}
                        one(whole, kind == "jpeg", row)
                    except Exception as e:
                        row = {"error": f"{type(e).__name__}: {e}", "boundary": row["boundary"]}
                made.append(row)
            arrays = []
            for f in keep:
                column = batch.column(f.name)
                if crop and f.name in ("width", "height"):
                    column = pa.array([r.get(f.name, v) for r, v in zip(made, column.to_pylist(), strict=True)], column.type)
                arrays.append(column)
            arrays += [pa.array([r.get(n) for r in made], pa.float64()) for n in names] + [pa.array([r["error"] for r in made], pa.string())]
            if find_page:
                arrays.append(pa.array([r["boundary"] for r in made], _BOUNDARY))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return images.select(*[f.name for f in keep], "data").mapInArrow(run, schema)


THUMBNAIL_METRICS = ["brightnessAvg", "brightnessStdevMax", "laplacianStdev", "edgeRatio", "foregroundRatio", "blankStdevMax"]


def thumbnail_metrics(images: DataFrame, overrides: dict[str, float] | None = None, side: int = 200) -> DataFrame:
    """megapixels, fileSize and the metrics of thumbnails of ``side`` pixels; ``data`` leaves.

    Images of fewer pixels than resolutionMin (a quick threshold, as those of
    edges and dark pixels) aren't looked at; their metrics are null.
    """
    t = PREFLIGHT | (overrides or {})
    keep = [f for f in images.schema.fields if f.name not in ("data", "megapixels", "fileSize", *THUMBNAIL_METRICS)]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in THUMBNAIL_METRICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{} if a is None or a.shape[0] * a.shape[1] / 1e6 < t["resolutionMin"] else preflight_metrics(a, side, t["laplacianEdgeThreshold"], t["binarizationThreshold"]) for a in rasters(batch)]
            arrays = [batch.column(f.name) for f in keep] + [pa.array([m.get(n) for m in made], pa.float64()) for n in THUMBNAIL_METRICS]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    small = images.select(*[f.name for f in keep], "data").mapInArrow(run, schema)
    return small.withColumns({"megapixels": F.col("width") * F.col("height") / F.lit(1e6), "fileSize": F.col("file_size").cast("double")})


def bounds(images: DataFrame) -> DataFrame:
    """``boundary`` STRUCT<detected, region, confidence> added; errors count as none found."""
    keep = [f for f in images.schema.fields if f.name != "boundary"]
    schema = T.StructType([*keep, T.StructField("boundary", T._parse_datatype_string(BOUNDARY))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_boundary(a) for a in rasters(batch)], _BOUNDARY)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], found], names=schema.names)

    return images.select(*[f.name for f in keep]).mapInArrow(run, schema)
