import random

import numpy as np
from pyspark.sql import functions as F

from inkgauge.llm import leakage as L


def slow_follows(item, doc):
    n, m = len(item), len(doc)
    for i in range(n):
        d = [0] * (m + 1)
        for row in range(i, n):
            new = [d[0] + 1]
            for j in range(m):
                new.append(min(d[j + 1] + 1, new[j] + 1, d[j] + (doc[j] != item[row])))
            d = new
            span = row + 1 - i
            if span * L.PART >= n and min(d) * L.EDITS <= span:
                return True
    return False


def slow_case(item, doc):
    a, b = L.words_of(item), L.words_of(doc)
    if not a or not b:
        return False
    runs = {tuple(b[i : i + 12]) for i in range(len(b) - 11)}
    return any(tuple(a[i : i + 12]) in runs for i in range(len(a) - 11)) or slow_follows(a, b)


def damage(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        out.append("zz" if x < rate * 2 / 3 else w)
        if rate * 2 / 3 <= x < rate:
            out.append(r.choice("abc"))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 7, 13, 15, 24, 31, 48])))) for k in range(25)]
    docs = []
    for k in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(60))]
        w = items[r.randrange(len(items))][1].split()
        part = w[r.randrange(len(w) // 2 + 1) :]
        part = part[: max(1, round(len(part) * r.choice([0.4, 0.5, 0.6, 1])))]
        words[len(words) // 2 : len(words) // 2] = damage(r, part, r.choice([0, 0.1, 0.16, 0.2, 0.4]))
        docs.append((k, ", ".join(words).upper() if k % 2 else "\n-".join(words)))
    return docs, items


def test_cases_equal_brute_force(spark):
    docs, items = corpus(5, 120)
    docs += [(900, None), (901, ""), (902, "!!!")]
    items += [(900, None), (901, ""), (903, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"item_id": F.lit(1), "verbatim": F.lit("x")})
    got = L.leaks(d, spark.createDataFrame(items, "item_id long, item_text string")).collect()
    want = {(a, b) for a, t in docs for b, u in items if slow_case(u or "", t or "")}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 50


def test_follows_equals_slow():
    r = random.Random(1)
    for _ in range(150):
        item = [r.randrange(1, 5) for _ in range(r.randrange(1, 20))]
        doc = damage(r, item, 0.3) if r.random() < 0.7 else [r.randrange(1, 5) for _ in range(20)]
        doc = [x if isinstance(x, int) else 0 for x in doc]
        assert L.follows(np.array(item), np.array(doc, dtype=int)) == slow_follows(item, doc)


def test_blocks_shards_and_long_texts(spark, monkeypatch):
    docs, items = corpus(8, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    whole = set(map(tuple, L.leaks(d, i).collect()))
    monkeypatch.setattr(L, "ITEM_WORDS", 60), monkeypatch.setattr(L, "SHARD", 200), monkeypatch.setattr(L, "PAIRS", 50)
    assert set(map(tuple, L.leaks(d, i).collect())) == whole
    filler = "lorem " * 300_000
    item = " ".join(f"q{k}" for k in range(30))
    long = spark.createDataFrame([(1, filler + item + filler)], "doc_id long, text string")
    assert [tuple(r) for r in L.leaks(long, spark.createDataFrame([(7, item)], "item_id long, item_text string")).collect()] == [(1, 7, True)]


def test_empty_and_clean(spark):
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    docs, items = corpus(2, 10)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    assert L.leaks(none_d, i).count() == 0 and L.leaks(d, none_i).count() == 0
    assert L.without_leaks(d, i).count() + L.leaks(d, i).select("doc_id").distinct().count() == 10


def slow_run(a, b):
    best = (0, 0, 0)
    for j in range(len(b)):
        for i in range(len(a)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def test_places_of_cases(spark):
    docs, items = corpus(11, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = L.places(d, i).collect()
    cases = {(r.doc_id, r.item_id, r.verbatim) for r in got}
    assert len(got) == len(cases) > 0 and cases == set(map(tuple, L.leaks(d, i).collect()))
    for r in got:
        a, b = L.words_of(dict(items)[r.item_id]), L.words_of(dict(docs)[r.doc_id])
        assert (r.words, r.item_offset, r.text_offset) == slow_run(a, b)
        assert not r.verbatim or r.words >= L.EXACT
