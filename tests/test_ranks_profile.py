import hashlib
import math
import random
import statistics

from pyspark.sql import functions as F

from inkgauge.operators import profile as P
from inkgauge.operators import rollup
from inkgauge.operators.ranks import order_statistics, positions


def test_positions_and_statistics(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(12), i) for i in range(700)] + [("hot", 5, 1000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = positions(df, ["g"], [F.col("v").asc(), F.col("id").asc()]).collect()
    for g in ("a", "b", None, "hot"):
        own = sorted((x.v, x.id) for x in got if x.g == g)
        assert [x.position for x in sorted((x for x in got if x.g == g), key=lambda x: (x.v, x.id))] == list(range(len(own)))
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for down in (False, True):
        ranks = spark.createDataFrame([(g, k) for g in ("a", None, "hot") for k in (0, 1, 17, 200, 400, 99999)], "g string, rank long")
        stat = {(x.g, x["rank"]): x.v for x in order_statistics(counts, ["g"], "v", "n", ranks, down).collect()}
        for g in ("a", None, "hot"):
            own = sorted((x[1] for x in rows if x[0] == g), reverse=down)
            assert {k: v for (gg, k), v in stat.items() if gg == g} == {k: own[k - 1] for k in (1, 17, 200, 400) if k <= len(own)}


COLS = "row_id long, load_id int, mode string, brightnessAvg double, fftHighFreqRatio double, zoneSharpness0 double"


def brute(rows):
    out, loads = set(), {}
    for c, (i, lo, hi, slow) in {"brightnessAvg": (3, 0, 255, False), "fftHighFreqRatio": (4, 0, 1, True), "zoneSharpness0": (5, 0, 127.5, True)}.items():
        for r in rows:
            v, mode = r[i], (r[2] or "").strip().lower()
            good = v is not None and v == v and lo <= v <= hi
            if v is not None and (not good or slow and mode == "fast"):
                out.add((c, r[1], r[0]))
            if not slow or mode == "thorough":
                loads.setdefault((c, r[1]), []).append(v if good or v is None else "bad")
        of = {k[1]: v for k, v in loads.items() if k[0] == c}
        share = {k: sum(x is None for x in v) / len(v) for k, v in of.items()}
        vals = {k: [x for x in v if x not in (None, "bad")] for k, v in of.items()}
        med = {k: statistics.median(v) for k, v in vals.items() if v}
        for k in of:
            up = share[k] > statistics.median(share.values()) + 0.2
            off = k in med and not 0.65 * statistics.median(med.values()) <= med[k] <= 1.5 * statistics.median(med.values())
            if up or off or len(set(vals[k])) * 4 < len(vals[k]):
                out.add((c, k, 0))
    return out


def test_found_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(1500):
        load = r.randrange(1, 8)
        b = r.gauss(150, 10) * (0.5 if load == 2 else 1)
        rows.append((i + 1, load if load < 7 else None, r.choice(["fast", " Thorough", "thorough", None]), r.choice([None] * (9 if load == 3 else 1) + [b] * 12 + [float("nan"), float("inf"), -0.5, 255.0]), round(r.random(), 1) if load == 4 else r.random(), r.choice([None, 20 + r.random(), 127.5, 127.6])))
    df = spark.createDataFrame(rows, COLS).withColumns({"value": F.lit(1), "low": F.lit("x"), "n": F.lit(3)})
    got = [tuple(x) for x in P.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {x[1] for x in got if x[2] == 0} >= {2, 3, 4}


def test_profile_drift_and_empty(spark):
    none = spark.createDataFrame([], COLS)
    assert P.found(none).count() == 0 and P.profile(none, P.CHECKS).count() == 0 and P.drift(none).count() == 0
    rows = [(i, 1 + i // 100, "thorough", float(i % 100) + (100 if i >= 200 else 0), 0.5, 1.0) for i in range(300)] + [(900, 1, "fast", None, 0.1, float("nan"))]
    df = spark.createDataFrame(rows, COLS)
    p = {r.column_name: r for r in P.profile(df, P.CHECKS).collect()}
    assert (p["brightnessAvg"].nulls, p["brightnessAvg"].distincts, p["brightnessAvg"].high) == (1, 200, 199.0)
    assert p["zoneSharpness0"].impossible == 1 and p["fftHighFreqRatio"].due == 300 and p["fftHighFreqRatio"].impossible == 1
    d = {(r.column_name, r.load_id): r.psi for r in P.drift(df).collect()}
    assert d["brightnessAvg", 2] == 0 and d["brightnessAvg", 3] > 1


def brute_drift(by_load, keys):
    """{load: (n, psi, chi)} from {load: [bin, ...]}; ``keys`` are fixed bins, else those seen so far."""
    out, past = {}, []
    for load in sorted(by_load):
        now = by_load[load]
        if past:
            ks = keys or sorted(set(past) | set(now))
            h, r = [max(now.count(k), 0.5) for k in ks], [max(past.count(k), 0.5) for k in ks]
            n, m = sum(h), sum(r)
            out[load] = (len(now), sum((a / n - b / m) * math.log((a / n) / (b / m)) for a, b in zip(h, r, strict=True)), sum((a - b * n / m) ** 2 / (b * n / m) for a, b in zip(h, r, strict=True)))
        past = past + now
    return out


def test_drift_of_every_column(spark):
    r = random.Random(5)
    rows = [(i, 1 + i // 120, "thorough", r.uniform(0, 1 if i < 360 else 0.3), "abc"[r.randrange(3)] if i < 240 else r.choice("cdd"), f"p{r.randrange(90)}" if i % 7 else None, 50.0 + i % 9) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, load_id int, mode string, label double, source string, path string, dpi double")
    checks, texts = P.columns_of(df)
    assert set(checks) | set(texts) == set(df.columns) and checks["label"] == P.Check(0, 1) and checks["dpi"] == P.ALL_CHECKS["dpi"]
    got = {(x.column_name, x.load_id): x for x in P.drift(df, checks, texts=texts).collect()}
    assert {c for c, _ in got} == set(df.columns) and len(got) == 7 * 4
    for i, c in ((0, "row_id"), (3, "label"), (4, "source"), (5, "path"), (6, "dpi")):
        own = [(x[1], x[i]) for x in rows if x[i] is not None]
        low, high = min(v for _, v in own), max(v for _, v in own)
        binned = {}
        for load, v in own:
            binned.setdefault(load, []).append(v if isinstance(v, str) else min(int((v - low) / (high - low) * 10), 9))
        for load, (n, psi, chi) in brute_drift(binned, None if c in texts else range(10)).items():
            x = got[c, load]
            assert x.n == n and abs(x.psi - psi) < 1e-5 and abs(x.chi_square - chi) < 1e-2, (c, load)
    assert got["source", 3].psi > 1 and got["label", 4].psi > 0.5


def test_times_are_numbers(spark):
    df = spark.sql("select 1L as row_id, 1 as load_id, 'fast' as mode, timestamp_ntz'1970-01-02 03:04:05.25' as loaded_at")
    checks, _ = P.columns_of(df)
    assert {x.column_name: x.value for x in P.cells(df, checks, []).collect()}["loaded_at"] == 86400 + 3 * 3600 + 4 * 60 + 5.25


def test_profile_of_every_column_and_load(spark):
    rows = [(1, 1, "fast", 0.5, "a"), (2, 1, "thorough", 1.5, None), (3, 2, "fast", None, "b"), (4, 2, "fast", 0.25, "b"), (5, 2, None, 0.75, "")]
    df = spark.createDataFrame(rows, "row_id long, load_id int, mode string, label double, preset string")
    p = {x.column_name: x for x in P.profile_all(df).collect()}
    assert set(p) == set(df.columns)
    assert (p["label"].due, p["label"].nulls, p["label"].in_range, p["label"].low, p["label"].high, p["label"].impossible) == (5, 1, 3, 0.25, 0.75, 1)
    assert (p["preset"].nulls, p["preset"].distincts, p["preset"].low_text, p["preset"].high_text) == (1, 3, "", "b")
    by = {(x.column_name, x.load_id): x for x in P.loads_all(df).collect()}
    assert len(by) == 10 and (by["label", 2].due, by["label", 2].nulls, by["label", 2].median) == (3, 1, 0.5)
    assert (by["preset", 1].nulls, by["preset", 2].distinct_in_range, by["mode", 2].nulls) == (1, 2, 1)


def test_shuffle_places_every_row(spark):
    paths = [f"a/{i}.jpg" for i in range(731)]
    got = rollup.shuffle_places(spark.createDataFrame([(p,) for p in paths], "path string"), "path", 7).collect()
    order = sorted(paths, key=lambda p: (hashlib.md5(f"{p}#7".encode()).hexdigest(), p))
    assert sorted((x.place, x.path) for x in got) == list(enumerate(order, 1))


def test_sorted_places_of_every_row(spark):
    r = random.Random(9)
    rows = [(r.choice([None, "B", "b", "a/x", "A/y", "c"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, id long")
    for down in (True, False):
        named = sorted(sorted((x for x in rows if x[0] is not None), key=lambda x: x[1]), key=lambda x: x[0].lower(), reverse=down)
        order = [i for _, i in named] + [i for p, i in rows if p is None]
        assert [x.id for x in sorted(rollup.sorted_places(df, "path", "id", down).collect(), key=lambda x: x.place)] == order
