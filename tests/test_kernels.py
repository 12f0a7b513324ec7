import numpy as np
import pytest

from inkgauge.functions.constants import FEATURES
from inkgauge.operators import degrade, kernels as K


def noise(h=120, w=160, seed=1, c=None):
    return np.random.default_rng(seed).integers(0, 256, (h, w) if c is None else (h, w, c), dtype=np.uint8)


def test_grey_and_alpha():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], dtype=np.uint8)
    assert K.to_grey(rgb).tolist() == [[76, 150, 29, 255]]
    assert K.on_white(np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]], dtype=np.uint8)).tolist() == [[[255, 255, 255], [10, 20, 30]]]


def test_laplacian_by_hand():
    a = noise(9, 11)
    p, got = np.pad(a.astype(int), 1, mode="edge"), K.laplacian(a)
    for y in range(9):
        for x in range(11):
            assert got[y, x] == np.clip(9 * p[y + 1, x + 1] - p[y : y + 3, x : x + 3].sum(), 0, 255)


def test_shrink_keeps_mean_and_never_grows():
    a = noise(90, 130)
    assert K.shrink(a, 500).shape == (90, 130)
    s = K.shrink(a, 65)
    assert s.shape == (45, 65) and abs(s.mean() - a.mean()) < 1e-9
    assert np.allclose(s[0, 0], a[:2, :2].mean())


def test_spectrum_of_a_cosine():
    x = np.arange(64)
    g = 128 + 50 * np.cos(2 * np.pi * 8 * x / 64)[None, :] * np.ones((64, 1))
    s = K.spectrum(g)
    assert np.unravel_index(np.argmax(s.power), s.power.shape)[1] in (8, 56)
    assert K.spectrum(np.zeros((31, 64))) is None
    assert K.spectrum(np.full((64, 64), 9.0)).energy < 1e-12
    assert K.spectral_peaks(s) > 0 and 0 <= K.high_frequency(s) <= 1
    assert K.high_frequency(K.spectrum(noise(128, 128))) > K.high_frequency(K.spectrum(degrade.blur(noise(128, 128), 0.5, None)))


def test_directional_ratio_sees_motion():
    a = noise(256, 256)
    moved = degrade.motion_blur(a, 1.0, np.random.default_rng(0))
    assert K.directional_ratio(K.spectrum(moved)) > K.directional_ratio(K.spectrum(a))


def test_blockiness():
    steps = np.repeat(np.repeat(noise(8, 8), 8, 0), 8, 1)
    assert K.blockiness(steps) == 10.0 and K.blockiness(noise(15, 40)) == 0 and K.blockiness(np.full((32, 32), 7, np.uint8)) == 0
    assert K.blockiness(noise(64, 64)) < 0.2


def brute_components(dark):
    h, w = dark.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if dark[y, x] and (y, x) not in seen:
                todo, part = [(y, x)], []
                seen.add((y, x))
                while todo:
                    a, b = todo.pop()
                    part.append((a, b))
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            p = (a + i, b + j)
                            if 0 <= p[0] < h and 0 <= p[1] < w and dark[p] and p not in seen:
                                seen.add(p), todo.append(p)
                rim = sum(a in (0, h - 1) or b in (0, w - 1) or not (dark[a - 1, b] and dark[a + 1, b] and dark[a, b - 1] and dark[a, b + 1]) for a, b in part)
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                out.append((len(part), sum(xs) / len(part), sum(ys) / len(part), min(xs), max(xs), min(ys), max(ys), rim))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_flood_fill(seed):
    dark = np.random.default_rng(seed).random((23, 31)) < [0.1, 0.3, 0.45, 0.6, 0.02, 0.9][seed]
    got, want = K.components(dark), brute_components(dark)
    keys = ("area", "cx", "cy", "min_x", "max_x", "min_y", "max_y", "perimeter")
    assert [tuple(round(float(got[k][i]), 9) for k in keys) for i in range(len(got["area"]))] == [tuple(round(float(v), 9) for v in r) for r in want]


def test_components_of_nothing_and_noise(monkeypatch):
    assert len(K.components(np.zeros((5, 5), bool))["area"]) == 0
    monkeypatch.setattr(K, "MAX_RUNS", 3)
    spots = np.zeros((9, 9), bool)
    spots[::2, ::2] = True
    assert K.components(spots) is None


def page(wave=0.0, jitter=0):
    g, r = np.full((400, 400), 230, np.uint8), np.random.default_rng(3)
    for row in range(8):
        for col in range(20):
            y, s = int(30 + row * 45 + wave * np.sin(col / 3)), 8 + int(r.integers(0, jitter + 1))
            g[y : y + s, 10 + col * 19 : 10 + col * 19 + s] = 20
    return g


def test_text_geometry():
    assert K.text_geometry(np.zeros((99, 200), np.uint8)) is None
    assert K.text_geometry(np.full((100, 100), 255, np.uint8)) == (0.0, 0.0, 0.0)
    straight, wavy = K.text_geometry(page()), K.text_geometry(page(8))
    assert straight[0] < 1e-9 and straight[1] < 1e-9 and straight[2] < 1e-9 and wavy[0] > 0.005
    assert K.text_geometry(page(0, 4))[1] > 0.1
    assert K.text_geometry(np.where(page() < 128, 128, 255).astype(np.uint8)) == (0.0, 0.0, 0.0)
    assert K.text_geometry(np.where(page() < 128, 127, 255).astype(np.uint8)) == straight


def test_bounds():
    a = np.full((400, 300), 30, np.uint8)
    a[40:360, 30:270] = 220
    b = K.document_bounds(a)
    assert abs(b["x"] - 30) <= 6 and abs(b["y"] - 40) <= 6 and abs(b["width"] - 240) <= 12 and abs(b["height"] - 320) <= 12
    for bad in (np.full((300, 300), 230, np.uint8), np.full((300, 300), 20, np.uint8), np.full((300, 300), 120, np.uint8), a[:8, :8]):
        assert K.document_bounds(bad) is None


def test_skew_and_metrics():
    assert K.skew_angle(np.zeros((19, 50))) is None and K.skew_angle(np.zeros((50, 50))) is None
    lap = np.zeros((200, 200), np.uint8)
    for x in range(200):
        lap[50 + x // 4, x] = 200
    assert abs(K.skew_angle(lap) - np.degrees(np.arctan(0.25))) < 0.6
    m = K.thorough_metrics(noise(150, 150, c=3), True)
    assert set(m) == set(K.RASTER_METRICS) and set(K.RASTER_METRICS) <= set(FEATURES)
    assert set(K.fast_metrics(noise())) <= set(m)
    small = K.thorough_metrics(noise(10, 10))
    assert "zoneBrightness0" not in small and small["foregroundRatio"] > 0


@pytest.mark.parametrize("name", list(degrade.DAMAGES))
def test_damages_are_seeded_and_do_something(name):
    for a in (noise(64, 80), noise(64, 80, c=3)):
        one = degrade.DAMAGES[name](a, 0.5, degrade.generator("p", name, 1))
        assert one.dtype == np.uint8 and one.ndim == a.ndim and (one == degrade.DAMAGES[name](a, 0.5, degrade.generator("p", name, 1))).all()
        if not (name == "desaturate" and a.ndim == 2):
            assert one.shape != a.shape or (one != a).any()


def test_fft1d_and_inverse():
    x = np.random.default_rng(4).normal(size=16) + 1j * np.arange(16)
    k = np.arange(16)
    direct = (x * np.exp(-2j * np.pi * np.outer(k, k) / 16)).sum(axis=1)
    assert np.allclose(K.fft1d(x), direct) and np.allclose(K.fft1d(K.fft1d(x), inverse=True), x)
