import random

from pyspark.sql import functions as F

from inkgauge.llm import splits as S


def test_spellings_of_paths(spark):
    cases = [
        ("/srv/corpus/documents/very-good/C-7/contract-8b5ewy_p1.jpg", 7, "8b5ewy"),
        ("corpus.zip!/documents/very-good/c0000007/INVOICE%20GU75Y5%20p1.jpg", 7, "gu75y5"),
        ("D:\\scan\\corpus\\documents\\bad\\c0000012_FORM__AHZHFM_p1_degraded_glare.jpg", 12, "ahzhfm"),
        ("documents/good/letter-ypay7p_p1_c0003865.jpeg", 3865, "ypay7p"),
        ("/srv/c9/photos/good/c0001278_DSC00023854.jpg", 1278, None),
        ("cards/bad/badge-c12345_p2.png", None, "c12345"),
        ("/x/unsorted/scan 0001.png", None, None),
        (None, None, None),
        ("receipts/good/c000_till-vrzwzf.png", 0, "vrzwzf"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "path string")
    who, paper = S.entities(F.col("path"))
    got = [tuple(r) for r in df.select(who.alias("w"), paper.alias("p")).collect()]
    assert got == [(w, None if p is None else S.PAPER + int(p, 36)) for _, w, p in cases]


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_labels_equal_union_find(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(300) if i % 97] + [(1000, 1001 + i) for i in range(200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(180)]
    want = brute(links)
    edges = spark.createDataFrame(links, "u long, v long")
    nodes = spark.createDataFrame([(x,) for x in want], "node long")
    assert {r.node: r.label for r in S.smallest_labels(edges, nodes).collect()} == want


ROWS = "image_id long, path string, preset string"


def test_groups_and_images_without_names(spark):
    p = "/r/cards/good/"
    rows = [(1, p + "c5_badge-aaaaaa_p1.jpg", "card"), (2, p + "badge-aaaaaa_p2.jpg", "card"), (3, p + "c3_badge-aaaaaa.jpg", None), (4, p + "c3_scan 1.jpg", "card"), (5, p + "permit-zzzzzz.jpg", "card"), (6, p + "x.jpg", "card"), (7, None, None), (None, p + "c1_x.jpg", "card"), (8, p + "c9_x.jpg", "card"), (8, p + "badge-bbbbbb.jpg", "card"), (9, p + "c08_badge-bbbbbb.jpg", "card")]
    got = {r.image_id: r.group_no for r in S.found(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 3, 5: None, 6: None, 7: None, 8: 8, 9: 8}


def test_split_keeps_groups_and_shares(spark):
    r = random.Random(2)
    rows = [(i, f"/r/cards/good/c{7 if i % 10 == 0 else 100 + r.randrange(900)}_scan {i}.jpg", r.choice(["document", "document", "receipt", " Card", None])) for i in range(6000)]
    shares = spark.createDataFrame([("train", 80), ("validation", 10), ("test", 10)], "split string, share_percent int")
    got = S.assign(spark.createDataFrame(rows, ROWS), shares).collect()
    assert len(got) == 6000 and all(x.split for x in got)
    by = {}
    for x in got:
        by.setdefault(x.group_no, set()).add(x.split)
    assert all(len(v) == 1 for v in by.values())
    for preset in ("document", "receipt", "card"):
        own = [x for x in got if x.preset == preset]
        for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(sum(x.split == split for x in own) / len(own) - share) < 0.03


def test_empty(spark):
    shares = spark.createDataFrame([("train", 100)], "split string, share_percent int")
    none = spark.createDataFrame([], ROWS)
    assert S.found(none).count() == 0 and S.assign(none, shares).count() == 0
