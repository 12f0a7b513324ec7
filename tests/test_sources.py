import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkgauge.operators import degrade, kernels, rollup
from inkgauge.plans.engine import QualityEngine, thumbnail_metrics
from inkgauge.sources import files
from inkgauge.functions.constants import FEATURES


def png(a):
    h, w = a.shape[:2]
    kind = 0 if a.ndim == 2 else 2
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def corpus(tmp_path):
    r = np.random.default_rng(1)
    made = {"documents/good/a.png": png(r.integers(0, 255, (700, 600, 3), dtype=np.uint8)), "receipts/bad/b.png": png(np.full((900, 300), 250, np.uint8)), "cards/good/broken.png": b"\x89PNG\r\n\x1a\nrubbish", "cards/bad/d.pdf": b"%PDF-1.4 two pages"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_files_to_results(spark, tmp_path):
    root = corpus(tmp_path)
    got = {r.path.rsplit("/", 1)[1]: r for r in QualityEngine(mode="thorough").check(files.read_images(spark, root)).collect()}
    assert got["a.png"].status == "ok" and got["a.png"].metadata.megapixels == 0.42 and got["a.png"].metadata.format == "png"
    assert "blank-page" in [i.code for i in got["b.png"].issues] and not getattr(got["b.png"], "pass")
    assert got["broken.png"].status == "error" and getattr(got["broken.png"], "pass") and got["broken.png"].score == 1.0
    strict = QualityEngine().with_options(on_error="fail").check(files.read_images(spark, root)).filter("status = 'error'").collect()
    assert strict and not any(getattr(r, "pass") for r in strict)
    scan = {r.path.rsplit("/", 1)[1]: (r.category, r.tier, r.preset) for r in files.scan(spark, root).collect()}
    assert scan["b.png"] == ("receipts", "bad", "receipt") and len(scan) == 4
    kinds = {r.format: r.status for r in files.read_files(spark, root).collect()}
    assert kinds == {"png": "ok", "pdf": "ok"}


def test_channel_order(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png(np.full((40, 40, 3), [200, 10, 20], np.uint8)))
    r = files.read_images(spark, str(tmp_path)).collect()[0]
    assert list(bytes(r.data)[:3]) == [200, 10, 20]


def test_pages_and_failing_renderer(spark, tmp_path):
    root = corpus(tmp_path)

    def renderer(content, pages):
        for p in (1, 2, 3):
            yield p, 500, 700, 1, bytes([200 - 90 * (p == 2)]) * 350_000

    pages = files.render_pages(files.read_files(spark, root), renderer, "1-2,9").withColumn("format", F.lit("pdf")).withColumn("density", F.lit(None).cast("double"))
    assert sorted(r.page for r in pages.select("page").collect()) == [1, 2]
    doc = QualityEngine(preset="document").check_pages(pages).collect()[0]
    assert len(doc.pageResults) == 2 and doc.worstPageScore <= doc.score
    assert files.render_pages(files.read_files(spark, root), lambda c, p: 1 / 0, "all").collect()[0].error.startswith("ZeroDivision")


def test_plugins_degrade_and_preflight(spark):
    a = np.random.default_rng(2).integers(0, 255, (600, 600), dtype=np.uint8)
    rows = [("p", 600, 600, 1, bytearray(a.tobytes()), 90_000, "png", None), ("q", 9, 9, 1, bytearray(b"x"), 9, "png", None), ("r", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, width int, height int, n_channels int, data binary, file_size long, format string, density double")
    got = {r.path: r for r in kernels.raster_metrics(df, plugins={"mine": lambda g, s: g.mean(), "bad": lambda g, s: 1 / 0}).collect()}
    assert abs(got["p"].mine - a.mean()) < 1e-9 and got["p"].bad is None and got["q"].error and got["r"].error
    found = kernels.bounds(df).collect()
    assert [r.boundary.detected for r in found] == [False] * 3
    both = {r.path: r for r in kernels.raster_metrics(df, "fast", find_page=True).collect()}
    assert both["p"].boundary.region is None and both["r"].error
    damaged = degrade.degrade(df, ["blur", "shrink"]).collect()
    assert damaged[0].width < 600 and damaged[1].width == 9
    quick = {r.path: r for r in thumbnail_metrics(df).collect()}
    assert quick["p"].laplacianStdev > 5 and quick["q"].brightnessAvg is None
    assert [getattr(r, "pass") for r in QualityEngine().preflight(df).collect()][0]


def test_page_found_decides_preset(spark):
    a = np.full((400, 1100), 30, np.uint8)
    a[40:360, 100:1000] = 220
    df = spark.createDataFrame([("p", 1100, 400, 1, bytearray(a.tobytes()), 90_000, "png", None)], "path string, width int, height int, n_channels int, data binary, file_size long, format string, density double")
    r = QualityEngine().check(df).collect()[0]
    assert r.boundary.detected and r.preset == "receipt"
    own = F.struct(F.lit(True).alias("detected"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(600.0).alias("width"), F.lit(400.0).alias("height")).alias("region"), F.lit(1.0).alias("confidence"))
    assert QualityEngine(mode="thorough", boundary=own).check(df).collect()[0].preset == "card"
    assert QualityEngine(detect_bounds=False, preset="auto").check(df).collect()[0].preset == "receipt"


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', "card", "fast", 0.5, *([float("nan")] * 42)), ("d", "card", "fast", None, *[float(i) for i in range(42)])], "path string, preset string, mode string, label double, " + ", ".join(f"{c} double" for c in FEATURES))
    files.write_features(rows, str(tmp_path / "f"))
    back = {r.path: r for r in files.read_features(spark, str(tmp_path / "f")).collect()}
    assert back['a "b", c'].megapixels is None and back["d"].textCharShapeCV == 41.0 and back["d"].label is None
    (tmp_path / "labels.json").write_text('{"x/good/1.png": {"label": "good", "score": 0.7, "category": null, "issues": ["a"], "notes": "", "timestamp": "2024-01-02T03:04:05Z"}}')
    lab = files.read_labels(spark, str(tmp_path / "labels.json")).collect()[0]
    assert (lab.path, lab.score, lab.issues, lab.labeled_at.year) == ("x/good/1.png", 0.7, ["a"], 2024)
    files.write_results(spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int"), str(tmp_path / "r"))
    assert [r.path for r in spark.read.json(str(tmp_path / "r")).orderBy("path").collect()] == ["a", "b"]
    assert files.read_manifest(spark, str(tmp_path / "no.json"), corpus(tmp_path / "c")).count() == 4


def test_labels_upsert_and_split(spark):
    t = "label_id long, path string, label string, score double, category string, labeled_at timestamp"
    from datetime import datetime

    old = spark.createDataFrame([(1, "p", "good", 0.6, None, datetime(2020, 1, 1)), (2, "q", "bad", None, None, None)], t)
    new = spark.createDataFrame([(3, "p", "bad", None, "c", datetime(2021, 1, 1)), (4, None, "bad", None, None, None)], t)
    got = {r.path: r for r in files.merge_labels(old, new).collect()}
    assert got["p"].label == "bad" and got["p"].score is None and len(got) == 2
    paths = spark.createDataFrame([(f"p{i}", (i % 101) / 100) for i in range(4000)], "path string, label double")
    s = rollup.stratified_split(paths).collect()
    assert abs(sum(r.test for r in s) / len(s) - 0.15) < 0.02 and len(s) == 4000 - 40
