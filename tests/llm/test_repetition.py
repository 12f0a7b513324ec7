import random

from inkgauge.llm import repetition as R


def slow(text):
    kept = "\n".join(x for x in (text or "").split("\n") if not x.startswith("-")).lower()
    words = "".join(c if c.isalpha() else " " for c in kept).split()
    marks, seen = [False] * len(words), set()
    for i in range(len(words) - 7):
        run = tuple(words[i : i + 8])
        if run in seen:
            marks[i : i + 8] = [True] * 8
        seen.add(run)
    return len(words), sum(marks)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", "-a b c", "one two", "a " * 9, "x1y2 " * 30, "été Ünï " * 12, "a²b m³ ½c 中文 " * 9, "-\n- x\nb c d e f g h i j\n" * 3, "\r\n-a\r\nb"]
    for _ in range(60):
        words = [r.choice("abc") * r.randrange(1, 3) for _ in range(r.randrange(5, 80))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words))
            words += words[at : at + r.randrange(4, 20)]
        out.append(r.choice([" ", "\n", "\n-", ", "]).join(words))
    return out


def test_measure_equals_brute_force(spark, monkeypatch):
    for block in (R.BLOCK, 100):
        monkeypatch.setattr(R, "BLOCK", block)
        t = texts(1)
        df = spark.createDataFrame([(i, f"s{i % 4}" if i % 5 else None, x) for i, x in enumerate(t)], "doc_id long, source string, text string")
        got = {r.doc_id: (r.n_words, r.repeated) for r in R.measure(df).collect()}
        assert got == {i: slow(x) for i, x in enumerate(t)}


def test_share_limit_hosts_and_found(spark):
    rows = [(i, "spam" if i < 30 else f"h{i % 7}", "buy this now and get one more for free " * (6 if i < 20 else 1)) for i in range(120)] + [(500, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in R.repetition(df).collect()}
    assert len(got) == 121 and got[0].repetitive and got[0].host_marked and got[25].host_marked and not got[25].repetitive and not got[60].host_marked
    assert got[500].share is None and not got[500].repetitive
    assert 0 < got[60].host_rate < got[0].host_rate < 20 / 30  # shrunk towards the mean
    assert sorted(r.doc_id for r in R.found(df).collect()) == list(range(20))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert R.found(df).count() == 0 and R.hosts(R.measure(df)).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "s", "alpha beta gamma delta eps zeta eta theta iota " * 60_000)], "doc_id long, source string, text string")
    r = R.measure(df).collect()[0]
    assert r.n_words == 540_000 and r.repeated == 540_000 - 9
