import random

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import packing as P

LIMITS = "limit_id int, capacity_tokens int"


def check(rows, caps, got):
    texts = {i: len(t.encode()) for i, t in rows if t is not None and i is not None}
    for limit, cap in caps:
        own = [r for r in got if r.limit_id == limit]
        used, parts = {}, {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.piece, r.tokens))
        assert max(used.values()) <= cap
        assert {d: sum(t for _, t in p) for d, p in parts.items()} == texts
        for d, p in parts.items():
            assert sorted(x for x, _ in p) == list(range(max(1, -(-texts[d] // cap))))
    return {(li, d) for li, c in caps for d, n in texts.items() if n > c}


def test_everything_is_packed_and_fits(spark):
    r = random.Random(3)
    rows = [(i, "é" * r.choice([0, 3, 40, 51, 52, 128, 300, r.randrange(400)])) for i in range(1500)] + [(5000, None), (None, "no id")]
    caps = [(1, 64), (2, 256), (3, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit(1), "capacity": F.lit(2), "bin": F.lit("x"), "grp": F.lit(0)})
    limits = spark.createDataFrame(caps, LIMITS)
    got = P.pack(docs, limits).collect()
    cut = check(rows, caps, got)
    found = list(map(tuple, P.cut_texts(docs, limits).collect()))
    assert len(found) == len(cut) and set(found) == cut
    for r in P.fill(docs, limits).collect():
        assert r.filled > 0.85 and r.containers >= r.least


def test_bins_share_the_work_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "BIN", 50)
    rows = [(i, "x" * (7 if i % 3 else 90 + i % 9)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, [(1, 100)], P.pack(docs, spark.createDataFrame([(1, 100)], LIMITS)).collect())


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_all(seed):
    r = random.Random(seed)
    sizes = sorted({r.randrange(130, 1001) for _ in range(20)}, reverse=True)
    counts = [r.randrange(1, 60) for _ in sizes]
    made = P.configurations(sizes, counts, 1000)
    assert all(sum(sizes[g] * a for g, a in used.items()) <= 1000 for _, used in made)
    assert [sum(t * u.get(g, 0) for t, u in made) for g in range(len(sizes))] == counts


def test_configurations_of_a_huge_capacity():
    cap = 10**9 + 7
    sizes = [cap, cap - 1, cap // 2, cap // 3]
    made = P.configurations(sizes, [2, 3, 4, 5], cap)
    assert all(sum(sizes[g] * a for g, a in used.items()) <= cap for _, used in made)
    assert [sum(t * u.get(g, 0) for t, u in made) for g in range(4)] == [2, 3, 4, 5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    limits = spark.createDataFrame([(1, 2)], LIMITS)
    assert P.pack(none, limits).count() == 0
    assert P.pack(docs, spark.createDataFrame([], LIMITS)).count() == 0
    assert P.pack(docs, spark.createDataFrame([(None, 4), (1, 0)], LIMITS)).count() == 0
    assert P.cut_texts(docs, limits).count() == 1
