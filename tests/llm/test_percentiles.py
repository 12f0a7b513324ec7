import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import percentiles as P


@pytest.mark.parametrize("order", ["random", "rising", "falling", "ties"])
def test_error_stays_in_stated_bound(order):
    n = 60_000
    v = np.random.default_rng(1).lognormal(size=n)
    v = {"random": v, "rising": np.sort(v), "falling": np.sort(v)[::-1], "ties": np.floor(v * 2)}[order]
    parts = []
    for chunk in np.array_split(v, 7):
        s = P.Sketch(64, 4)
        for c in np.array_split(chunk, 5):
            s.add(c)
        parts.append(s)
    whole = P.Sketch(64, 4)
    for s in parts:
        whole.merge(s)
    assert whole.n == n and 0 < whole.err < n * 0.2
    assert sum(x[1] for x in whole.full) * 64 + len(whole.tail) == n
    ordered = np.sort(v)
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for q, got in zip(qs, whole.quantiles(qs), strict=True):
        rank = max(1, int(np.ceil(q * n - 1e-9)))
        low, high = np.searchsorted(ordered, got, "left") + 1, np.searchsorted(ordered, got, "right")
        assert low - whole.err <= rank <= high + whole.err


def test_production_size_is_tight():
    s = P.Sketch()
    s.add(np.random.default_rng(2).random(3_000_000))
    assert s.err / s.n < 0.01 and abs(s.quantiles([0.5])[0] - 0.5) < 0.01


def test_groups_merge_over_partitions(spark):
    rows = [(["a", None, "b"][i % 3], i % 2, float(i), [None, float("nan"), -1.0, float("inf"), 3.0][i % 5]) for i in range(3000)]
    df = spark.createDataFrame(rows, "preset string, load_id int, x double, y double").repartition(6).withColumn("n", F.lit("clash"))
    made = P.sketches(df, ["preset", "load_id"], ["x", "y"], k=32, b=3)
    got = {(r.preset, r.load_id, r.feature, r.q): r for r in P.percentiles(made, (0.5,), 32, 3).collect()}
    assert len(got) == 12
    for p in ("a", None, "b"):
        v = np.sort([r[2] for r in rows if r[0] == p and r[1] == 0])
        r = got[p, 0, "x", 0.5]
        assert r.n == 500 and 0 < r.rank_error < 200 and abs(np.searchsorted(v, r.value) + 1 - 250) <= r.rank_error
        assert got[p, 0, "y", 0.5].value == 3.0
    both = P.percentiles(P.merged(made.drop("load_id"), ["preset", "feature"], 32, 3), (0.5,), 32, 3).filter("feature = 'x'").collect()
    assert sorted(r.n for r in both) == [1000] * 3


def test_empty(spark):
    df = spark.createDataFrame([], "preset string, x double")
    assert P.percentiles(P.sketches(df, ["preset"], ["x"])).count() == 0
    assert P.Sketch().quantiles([0.5]) == [None]
