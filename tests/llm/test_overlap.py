import itertools
import random

from pyspark.sql import functions as F

from inkgauge.llm import overlap

COLS = "row_id long, image_id long, split string, source string, label double, width double, height double, " + ", ".join(f"{m} double" for m in overlap.MEASURES)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def brute(rows):
    got = set()
    ok = lambda v: v is not None and v == v and abs(v) != float("inf")
    for a, b in itertools.product(rows, rows):
        if (a[2] or "").strip().lower() != "train" or (b[2] or "").strip().lower() not in ("validation", "test") or a[1] is None or b[1] is None or a[1] == b[1]:
            continue
        x, y = a[5:], b[5:]
        if not all(map(ok, x + y)) or x[:2] != y[:2]:
            continue
        if all(abs(p - q) <= 0.005 * max(abs(p), abs(q)) for p, q in zip(x[2:], y[2:], strict=True)):
            got.add((min(a[1], b[1]), max(a[1], b[1])))
    return got


def random_rows(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = [r.choice([100.0, 200.0]), 300.0] + [r.choice([0.0, 1e-4, 0.37, 12.5, 180.0]) * (1 + r.choice([0, 0, 0.0049, 0.00502, -0.004, 0.02])) for _ in range(5)]
        if r.random() < 0.1:
            base[r.randrange(2, 7)] = r.choice([None, float("nan"), float("inf"), -1.0])
        rows.append((i, r.choice([None, *range(n // 3)]), r.choice(["train", " Train", "test", "validation", None]), "s", 0.5, *base))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = [r for s in range(3) for r in random_rows(150, s)]
    r = random.Random(9)
    for _ in range(200):  # near copies on both sides of the tolerance
        b = [100.0, 300.0, 150.0, 33.0, 21.0, 9.0, 0.08]
        rows.append((0, r.randrange(60), r.choice(["train", "test"]), "s", 0.1, *b[:2], *[v * (1 + r.uniform(-0.003, 0.003)) for v in b[2:]]))
    got = overlap.image_pairs(frame(spark, rows)).select("image_id_a", "image_id_b").collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute(rows)
    assert brute(rows)


def test_hot_gram_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 8)
    rows = [(i, i, "train" if i % 5 else "test", "s", 0.5, 10.0, 10.0, 100 + i * 1e-4, 30.0, 20.0, 10.0, 0.1) for i in range(200)]
    got = overlap.image_pairs(frame(spark, rows)).count()
    assert got == 160 * 40


def test_report_and_containment(spark):
    rows = [(1, 1, "train", "a", 0.1, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 2, "test", "A ", 0.9, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 3, "test", "a", 0.9, 6.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    f = frame(spark, rows)
    assert [tuple(r) for r in overlap.report(f).collect()] == [("test", "a", 2, 1)]
    assert [r.containment for r in overlap.class_links(overlap.classes(overlap.records(f))).collect()] == [1.0]


def test_empty_and_extra_columns(spark):
    f = frame(spark, [])
    assert overlap.image_pairs(f).count() == 0 and overlap.report(f).count() == 0
    one = frame(spark, random_rows(60, 3)).withColumns({"gram": F.lit(1), "side": F.lit("x"), "salt": F.lit(2), "images": F.lit(0), "t_width": F.lit(0)})
    assert set(map(tuple, overlap.image_pairs(one).select("image_id_a", "image_id_b").collect())) == brute(random_rows(60, 3))


def test_pair_counts_per_split_and_source(spark):
    same = [100.0, 80.0] + [10.0] * len(overlap.MEASURES)
    other = [100.0, 80.0] + [99.0] * len(overlap.MEASURES)
    rows = [(1, 1, "train", "a", 0.5, *same), (2, 2, "train", "a", 0.5, *same), (3, 3, "test", "B ", 0.5, *same), (4, 4, "validation", "b", 0.5, *same), (5, 5, "test", "b", 0.5, *same), (6, 6, "test", None, 0.5, *other), (7, 3, "test", "b", 0.5, *same)]
    got = {(r.split, r.source): r.pairs for r in overlap.pair_counts(frame(spark, rows)).collect()}
    assert got == {("test", "b"): 4, ("validation", "b"): 2, ("test", None): 0}
