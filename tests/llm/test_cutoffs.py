import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkgauge.llm import cutoffs as C

COLS = "result_id long, image_id long, source string, preset string, score double, analyzed_at timestamp"


def brute(rows, targets):
    last = {}
    for r in rows:
        if r[4] is None or not 0 <= r[4] <= 1:
            continue
        key = ("own", r[0]) if r[1] is None else r[1]
        if key not in last or (r[5] or datetime.min, r[0]) > (last[key][5] or datetime.min, last[key][0]):
            last[key] = r
    groups = {}
    for r in last.values():
        if r[2] is not None and r[3] is not None:
            groups.setdefault((r[2].strip().lower(), r[3]), []).append(r)
    want = {}
    for s, p, k in targets:
        if s is not None and k is not None:
            want[s.strip().lower(), p] = max(k, want.get((s.strip().lower(), p), 0))
    kept = set()
    for g, rs in groups.items():
        if g in want:
            rs.sort(key=lambda r: -r[4])
            at = max(1, math.ceil(want[g] * len(rs) / 100))
            if at <= len(rs):
                kept |= {r[0] for r in rs if r[4] >= rs[at - 1][4]}
    return kept


def rows_of(n, seed):
    r = random.Random(seed)
    t = datetime(2020, 1, 1)
    return [(i, r.choice([None, *range(n // 2)]), r.choice(["a", " A", "b", None, "c"]), r.choice(["x", "y", None]), r.choice([None, float("nan"), -0.1, 1.2, 0.5, 0.5, r.random(), 1.0, 0.0]), r.choice([None, t + timedelta(hours=r.randrange(9))])) for i in range(n)]


def test_equal_brute_force(spark):
    targets = [("a", "x", 33), ("A ", "x", 50), ("a", "y", 100), ("b", "x", 0), ("b", "y", 1), ("c", "x", 101), ("c", "y", None), ("z", "x", 10)]
    t = spark.createDataFrame(targets, "source string, preset string, keep_percent int")
    for seed in range(2):
        rows = rows_of(400, seed)
        df = spark.createDataFrame(rows, COLS).withColumns({"rank": F.lit(0), "n": F.lit("x"), "cutoff": F.lit(9)})
        got = [r.result_id for r in C.kept_rows(df, t).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, targets)
        cut = C.cutoffs(C.counting_rows(df), t).collect()
        assert sum(r.kept for r in cut) == len(got) and all(r.kept * 100 >= r.keep_percent * r.n for r in cut)


def test_hot_group_with_equal_scores(spark):
    rows = [(i, i, "a", "x", 0.25 if i % 3 else 0.75, None) for i in range(900)]
    t = spark.createDataFrame([("a", "x", 40)], "source string, preset string, keep_percent int")
    assert C.kept_rows(spark.createDataFrame(rows, COLS), t).count() == 900


def test_empty(spark):
    t = spark.createDataFrame([], "source string, preset string, keep_percent int")
    assert C.kept_rows(spark.createDataFrame(rows_of(50, 1), COLS), t).count() == 0
    assert C.kept_rows(spark.createDataFrame([], COLS), t).count() == 0
