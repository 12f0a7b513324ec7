import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import scalar as S
from inkgauge.functions.constants import FEATURES, GUIDANCE, PRESETS, THRESHOLDS
from inkgauge.operators import models, rollup, rules


def rows(spark, *changes, **common):
    base = {"megapixels": 4.0, "width": 2000.0, "height": 2000.0, "fileSize": 9e5, "brightnessAvg": 180.0, "brightnessStdevMax": 40.0, "laplacianMean": 20.0, "laplacianStdev": 30.0, "dpi": 72.0, "bpp": 2.0, "isJpeg": 1.0, "edgeRatio": 0.1}
    schema = ", ".join(f"`{c}` double" for c in FEATURES)
    return spark.createDataFrame([tuple((base | common | c).get(f) for f in FEATURES) for c in changes or ({},)], schema)


def codes(df, **o):
    return [[i.code for i in r.issues] for r in rules.judge(df, **({"preset": "document", "mode": "thorough"} | o)).collect()]


def test_constants():
    assert len(FEATURES) == 42 and len(THRESHOLDS) == 39 and len(GUIDANCE) == 35
    assert len({r.code for r in rules.RULES}) == 32 and all(r.limit in THRESHOLDS for r in rules.RULES)
    assert all(set(p) <= set(THRESHOLDS) for p in PRESETS.values())


def test_limits_are_strict(spark):
    t = THRESHOLDS
    for r in rules.RULES:
        limit = t[r.limit]
        also = {"shadowEdgeCenterDiff": 30.0} if r.code == "dark-shadow" else {"channelCount": 3.0} if r.code == "grayscale-in-color" else {}
        if r.code == "low-dpi":
            assert codes(rows(spark, {"dpi": 199.0}, {"dpi": 220.0})) == [[], []]
            assert codes(rows(spark, {"dpi": 220.0}, {"dpi": 200.0}), overrides={"dpiMin": 300}) == [["low-dpi"], []]
            continue
        step = max(abs(limit) * 0.01, 1e-4) * (1 if r.above else -1)
        on, over, lost, nan = codes(rows(spark, {r.metric: limit}, {r.metric: limit + step}, {r.metric: None}, {r.metric: float("nan")}, **also))
        assert r.code in over and r.code not in on + lost + nan, r.code


def test_fast_mode_holds_a_subset(spark):
    bad = rows(spark, {"edgeRatio": 0.0, "foregroundRatio": 0.0, "brightnessAvg": 10.0})
    fast, slow = codes(bad, mode="fast")[0], codes(bad)[0]
    assert fast == ["too-dark"] and set(fast) < set(slow)


def test_score_is_ordered_product_with_overrides(spark):
    bad = rows(spark, {"brightnessAvg": 10.0, "laplacianStdev": 1.0, "fileSize": 10.0})
    r = rules.judge(bad, "document").collect()[0]
    assert [i.penalty for i in r.issues] == [0.7, 0.6, 0.5] and r.score == 0.21 and not getattr(r, "pass") and r.confidence == "high"
    r = rules.judge(bad, "document", penalties={"brightness": 1.0, "sharpness": 1.0}).collect()[0]
    assert r.score == 0.7 and getattr(r, "pass")
    assert rules.judge(rows(spark), "document").collect()[0].score == 1.0


def test_exclusive_rules(spark):
    assert codes(rows(spark, {"laplacianMean": 90.0, "laplacianStdev": 1.0})) == [["noisy"]]
    assert codes(rows(spark, {"zoneBrightnessDiff": 99.0, "zoneSharpnessRatio": 0.1})) == [["uneven-zone-brightness"]]


def test_scorer_and_fallback(spark):
    df = rows(spark, {"dpi": 1.0}, {"dpi": 2.0}, {"dpi": 3.0}, {"dpi": 4.0})
    s = F.when(F.col("dpi") == 1, 0.444).when(F.col("dpi") == 2, float("nan")).when(F.col("dpi") == 3, 9.0)
    assert [r.score for r in rules.judge(df, "document", scorer=s).collect()] == [0.44, 1.0, 1.0, 1.0]


def test_auto_preset(spark):
    df = spark.createDataFrame([(300.0, 1000.0), (1600.0, 1000.0), (3200.0, 2000.0), (1000.0, 1000.0), (5.0, 0.0)], "w double, h double")
    got = [r[0] for r in df.select(S.detect_preset(F.col("w"), F.col("h"))).collect()]
    assert got == ["receipt", "card", "document", "document", "receipt"]
    own = rows(spark, {}, {}).withColumn("preset", F.lit(" CARD"))
    assert {r.preset for r in rules.judge(own).collect()} == {"card"}


def test_rounding_and_pages():
    assert S.parse_pages(" 1, 4,8-10,,9 ") == [1, 4, 8, 9, 10] and S.parse_pages("ALL") is None and S.parse_pages("1x-3") == [1, 2, 3]
    for bad in ("", "0", "3-1", "a", "1,b", "-2", "0-3"):
        with pytest.raises(ValueError):
            S.parse_pages(bad)


def test_half_up(spark):
    df = spark.createDataFrame([(0.285,), (0.125,), (0.005,), (1.0,)], "x double")
    assert [r[0] for r in df.select(S.half_up(F.col("x"))).collect()] == [0.28, 0.13, 0.01, 1.0]


def test_formats(spark):
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF89a", "webp": b"RIFF\0\0\0\0WEBP", "tiff": b"II*\0", "avif": b"\0\0\0\x1cftypavif", "heif": b"\0\0\0\x1cftypheic", "svg": b"<?xml?><SVG>", None: b"hello"}
    df = spark.createDataFrame([(k, v) for k, v in heads.items()], "k string, b binary")
    assert all(r.k == r.f for r in df.select("k", S.image_format(F.col("b")).alias("f")).collect())
    assert spark.createDataFrame([(b"%PDF-1.4",), (b"%PD",)], "b binary").filter(S.is_pdf(F.col("b"))).count() == 1


def test_preflight(spark):
    cols = "megapixels double, fileSize double, brightnessAvg double, brightnessStdevMax double, laplacianStdev double, edgeRatio double, foregroundRatio double, blankStdevMax double"
    good = (2.0, 1e6, 150.0, 40.0, 20.0, 0.1, 0.2, 40.0)
    df = spark.createDataFrame([good, (0.1, None, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (2.0, 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], cols)
    got = rules.preflight(df).collect()
    assert getattr(got[0], "pass") and [i.code for i in got[1].issues] == ["low-resolution"]
    assert [i.code for i in got[2].issues] == ["file-too-small", "too-dark", "blank-page", "blurry", "low-edge-density", "low-contrast"]
    assert [getattr(r, "pass") for r in rules.preflight(df, scorer=F.lit(0.4)).collect()] == [False] * 3


MODEL = {"trees": [[{"split": 0, "split_condition": 0.5, "missing": 1, "left": {"leaf": -0.2}, "right": {"leaf": 0.1}}], [{"split": 1, "split_condition": 2.0, "left": {"leaf": 0.1}, "right": {"leaf": 0.3}}], [], [{"split": 0}]], "base_score": 0.5, "objective": "reg:squarederror"}


def test_tree_forms_agree(spark):
    values = [None, float("nan"), 0.0, 0.5, 0.500001, 2.0, 9.0]
    data = list(itertools.product(values, values))
    df = spark.createDataFrame(data, "a double, b double")
    import numpy as np

    for objective in ("reg:squarederror", "binary:logistic"):
        m = MODEL | {"objective": objective}
        by_rows = models.evaluate(m, np.array([[np.nan if v is None else v for v in r] for r in data]))
        by_col = [r[0] for r in df.select(models.expression(m, ["a", "b"])).collect()]
        assert np.allclose(by_rows, by_col)
    assert models.evaluate(MODEL, np.array([[0.5, 2.0]]))[0] == pytest.approx(0.4)
    assert models.evaluate({"trees": None}, np.zeros((2, 2))).tolist() == [0.5, 0.5]
    loop = {"split": 0, "split_condition": 1.0}
    loop["left"] = loop["right"] = {"leaf": 1e308}
    assert models.evaluate({"trees": [[loop], [loop]], "base_score": 0.0}, np.array([[0.0]]))[0] == 0.5


def test_model_validation(tmp_path):
    for bad in (None, [], {}, {"a": 1}, {"a": {"trees": 1, "base_score": 0}}, {"a": {"trees": [], "base_score": "x"}}):
        with pytest.raises(ValueError):
            models.validate(bad)
    models.save({"m": MODEL}, str(tmp_path / "m.json"))
    assert models.load(str(tmp_path / "m.json")) == {"m": MODEL}


def test_training_learns_and_exports(spark):
    r = random.Random(1)
    data = [(x := r.random(), r.random(), min(1.0, max(0.0, 0.8 * (x > 0.5) + 0.1))) for _ in range(400)]
    df = spark.createDataFrame(data, "a double, b double, label double")
    m = models.train(df, ["a", "b"], rounds=5, depth=2)
    got = rollup.regression_metrics(df.withColumn("score", models.scorer(m, ["a", "b"]))).collect()[0]
    assert got.n == 400 and got.r2 > 0.9 and m["importances"][0] > 0.9


def test_pages_rollup(spark):
    one = rules.judge(rows(spark, {"fileSize": 10.0}, {"brightnessAvg": 10.0}, {}), "document").withColumn("page", F.when(F.col("fileSize") < 100, 1).when(F.col("brightnessAvg") < 50, 2).otherwise(3)).withColumn("doc_id", F.lit(1))
    r = rollup.pages(one).collect()[0]
    assert (r.score, r.worstPageScore, getattr(r, "pass"), r.preset, r.confidence) == (0.77, 0.6, True, "document", "high")
    assert len(r.pageResults) == 3 and all(i.page is not None for i in r.issues) and len(r.issues) == 2


def test_models_are_trained_at_full_size(spark, monkeypatch):
    import os

    from inkgauge.plans import queries

    d = os.environ.get("INKGAUGE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    made = []

    def train(rows, features, label="label", rounds=20, depth=4, seed=42):
        made.append((len(features), rounds, depth))
        return {"trees": [[{"leaf": 0.5}]], "base_score": 0.0, "objective": "reg:squarederror"}

    monkeypatch.setattr(queries.models, "train", train)
    got = queries.model_train(spark, d).collect()
    assert made == [(15, 100, 4), (42, 100, 4), (7, 100, 4)] and {r.model for r in got} == {"fast", "thorough", "preflight"}
    made.clear()
    got = queries.model_folds(spark, d).collect()
    assert made == [(15, 100, 4)] * 5 + [(42, 100, 4)] * 5 + [(7, 100, 4)] * 5
    assert {(r.model, r.fold) for r in got} == {(m, k) for m in ("fast", "thorough", "preflight") for k in range(5)}


def test_violations_keep_the_plan_small(spark):
    full = rows(spark, {"fileSize": 10.0, "width": 1.0}, {"width": 1.0}, {"brightnessAvg": 10.0, "fileSize": 10.0, "width": 2.0}, {"width": 3.0}, {})
    judged = rules.judge(full, "document", mode="thorough").select(F.col("width").alias("imageId"), "pass")
    quick = spark.createDataFrame([(1.0, False), (1.0, False), (2.0, False), (3.0, True), (None, False)], "imageId double, pass boolean")
    bad = rollup.monotone_violations(quick, judged, "imageId")
    read = bad._jdf.queryExecution().optimizedPlan().toString().count("brightnessAvg")
    assert read < 50 and [r.imageId for r in bad.collect()] == [1.0]


def _blocks(data, cuts, size):
    import numpy as np
    import pyarrow as pa

    from inkgauge.operators import boosting

    def batches():
        for at in range(0, len(data), 100):
            part = data[at : at + 100]
            x = [bytes(int(np.searchsorted(c, r[j])) for j, c in enumerate(cuts)) for r in part]
            yield pa.RecordBatch.from_arrays([pa.array([r[-1] for r in part], pa.int64()), pa.array([r[-2] for r in part], pa.float64()), pa.array(x, pa.binary())], names=["h", "y", "x"])

    boosting.BLOCK, old = size, boosting.BLOCK
    try:
        return boosting.read_blocks(batches(), len(cuts), None)
    finally:
        boosting.BLOCK = old


def test_trees_equal_brute_force():
    import numpy as np

    from inkgauge.operators import boosting

    r = random.Random(3)
    data = [(float(x := r.randrange(60)), float(y := r.randrange(5)), r.choice([-1.0, 0.5]), min(1.0, x / 100 + (y == 2) * 0.3 + r.random() * 0.1), r.randrange(1 << 32)) for _ in range(900)]
    x = np.array([d[:3] for d in data])
    cuts = boosting.cuts_of(boosting.collapse([(x[at : at + 50].T, 1.0) for at in range(0, 900, 50)])[0])
    assert [len(c) for c in cuts] == [31, 4, 1] and cuts[1].tolist() == [0.5, 1.5, 2.5, 3.5]
    one = boosting.grow(_blocks(data, cuts, 1 << 16), cuts, 12, 3, 7, share=1.0)
    assert one == boosting.grow(_blocks(random.Random(1).sample(data, 900), cuts, 128), cuts, 12, 3, 7, share=1.0)

    label, score = np.array([d[3] for d in data]), np.zeros(900)

    def brute(rows, target, depth, weight):
        mean = target[rows].mean()
        options = [(((target[rows] - mean) ** 2).sum() - sum(((target[s] - target[s].mean()) ** 2).sum() for s in (rows[x[rows, f] <= c], rows[x[rows, f] > c])), -f, -c) for f in range(3) for c in cuts[f] if 0 < (x[rows, f] <= c).sum() < len(rows)]
        if not depth or not options or max(options)[0] < 1e-6:
            score[rows] += mean * weight
            return
        _, f, c = max(options)
        brute(rows[x[rows, -f] <= -c], target, depth - 1, weight)
        brute(rows[x[rows, -f] > -c], target, depth - 1, weight)

    for t in range(12):
        brute(np.arange(900), label if t == 0 else 2 * (label - score), 3, 1.0 if t == 0 else 0.1)
    got = models.evaluate({"trees": one["trees"], "base_score": 0.0}, x)
    assert np.abs(got - np.clip(score, 0, 1)).max() < 1e-3
    half = boosting.grow(_blocks(data, cuts, 128), cuts, 12, 3, 7)
    assert half != one and half == boosting.grow(_blocks(data[::-1], cuts, 1 << 16), cuts, 12, 3, 7)


def test_folds_take_few_jobs(spark):
    r = random.Random(2)
    data = [(f"p{i}", None if i % 9 == 0 else (x := r.random()), r.random(), 0.8 * (i % 9 != 0 and x > 0.5) + 0.1) for i in range(600)]
    df = spark.createDataFrame(data, "path string, a double, b double, label double").repartition(40)
    before = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    got = models.cross_validate(df, ["a", "b"], "path", rounds=20, depth=3).collect()
    assert sorted(g.fold for g in got) == [0, 1, 2, 3, 4] and sum(g.n for g in got) == 600 and all(g.r2 > 0.9 for g in got)
    assert max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 60
