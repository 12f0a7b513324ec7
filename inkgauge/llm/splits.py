"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import join_same, positions
from ..session import discard, settle

#: Tier folders, kinds of paper and label strata of the data.
TIERS = "very-good|good|very-bad|bad|unsorted"
KINDS = "contract|invoice|letter|form|slip|till|bill|idcard|badge|permit|photo|snap"
STRATA = ["document", "receipt", "card"]
#: Paper numbers lie above every contributor number.
PAPER = 1 << 61
#: Groups of more than this share of all images are placed one by one; there are at most 1/LARGE.
LARGE = 0.001
_GOLDEN = 0.6180339887498949


def _below_tier(path: Column) -> Column:
    """Lower-case, percent-decoded part of a path below its tier folder; all of it if there is none."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))
    return F.regexp_replace(plain, rf"^.*?[/\\](?:{TIERS})[/\\]", "")


def entities(path: Column) -> tuple[Column, Column]:
    """Contributor number and paper number (PAPER + code in base 36) of a path, each or both null.

    The paper is taken out before the contributor is looked for, as a code may
    look like one. Contributor numbers have up to 18 digits besides zeros.
    """
    paper = rf"(?<![a-z])(?:{KINDS})[^a-z0-9]+([a-z0-9]{{6}})(?![a-z0-9])"
    rest = _below_tier(path)
    code = F.regexp_extract(rest, paper, 1)
    number = F.regexp_extract(F.regexp_replace(rest, paper, " "), r"(?<![a-z])c-?0*([0-9]{1,18})(?![0-9])", 1)
    as_paper = F.when(code != "", F.lit(PAPER) + F.conv(code, 36, 10).cast("long"))
    return F.when(number != "", number.cast("long")), as_paper


def smallest_labels(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's connected component.

    Every round a node takes the smallest label among its own and its
    neighbours', then the label of its label (a jump), so the rounds follow the
    logarithm of a component's length. The loop ends when no label changes;
    only that count reaches the driver. Labels are written each round.
    """
    both = settle(edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(nodes.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        sent = both.join(labels, both.u == labels.node).select(F.col("v").alias("node"), "label")
        near = labels.select("node", "label", F.col("label").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("long")))
        near = near.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = settle(near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            return labels.select("node", "label")
    raise RuntimeError("labels still change; raise max_rounds")


def groups(features: DataFrame) -> DataFrame:
    """(image_id, label, preset): every image with the label of its group.

    The graph has images on one side, contributors and papers on the other. An
    image stands for the links among its own entities, so the propagation runs
    on distinct entity pairs and not on records. Labels are contributor
    numbers, paper numbers where a group has no contributor, and null for an
    image that names neither (a group of its own). Rows without image id are
    left out; an image with several presets counts with the smallest.
    """
    who, paper = entities(F.col("path"))
    preset = F.lower(F.trim(F.col("preset")))
    rows = features.filter(F.col("image_id").isNotNull()).select("image_id", "path", preset.alias("preset")).distinct()
    named = settle(rows.select("image_id", "preset", who.alias("who"), paper.alias("paper")).distinct())
    own = named.groupBy("image_id").agg(F.least(F.min("who"), F.min("paper")).alias("node"), F.min("preset").alias("preset"))
    pairs = named.select("image_id", F.explode(F.array("who", "paper")).alias("other")).filter("other is not null").distinct()
    edges = settle(pairs.join(own.select("image_id", "node"), "image_id").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    labels = smallest_labels(edges, nodes)
    return own.join(labels, "node", "left").select("image_id", "label", "preset")


def found(features: DataFrame) -> DataFrame:
    """(image_id, group_no): null where no image of the group names a contributor."""
    return groups(features).select("image_id", F.when(F.col("label") < PAPER, F.col("label")).alias("group_no"))


def _place(big: list, shares: list[tuple[str, float]], totals: list[int]) -> dict[int, str]:
    """Largest first, each to the split that then deviates least from its shares."""
    have = {s: [0.0] * len(totals) for s, _ in shares}
    out = {}
    for r in sorted(big, key=lambda r: (-r["n"], r["label"])):
        def cost(name: str, share: float, r=r) -> float:
            now = [(h + x - share * t) for h, x, t in zip(have[name], r["counts"], totals, strict=True)]
            was = [(h - share * t) for h, t in zip(have[name], totals, strict=True)]
            return sum(max(a, 0) ** 2 / max(share, 1e-9) - max(b, 0) ** 2 / max(share, 1e-9) + (a * a - b * b) * 1e-3 for a, b in zip(now, was, strict=True))

        best = min(shares, key=lambda s: (cost(*s), -s[1], s[0]))[0]
        out[r["label"]] = best
        have[best] = [h + x for h, x in zip(have[best], r["counts"], strict=True)]
    return out


def assign(features: DataFrame, split_shares: DataFrame) -> DataFrame:
    """(image_id, group_no, preset, split): whole groups in the wanted shares.

    Groups are weighed by their images per preset. The few that hold more than
    LARGE of all images (at most 1/LARGE, a fixed bound) are placed one by one
    where they disturb the shares least. All others are sorted by leading
    preset, mix and size across the cluster; the golden-ratio sequence over
    that order spreads every run of similar groups over the splits in what is
    left of each preset's quota. An image without any entity is its own group.
    Shares are scaled to sum to 1; an empty share table puts all into null.
    """
    named = settle(groups(features))
    key = F.coalesce("label", -F.col("image_id") - F.lit(1))
    stratum = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STRATA]), F.col("preset")).cast("int"), F.lit(0))
    slots = range(len(STRATA) + 1)
    sized = settle(named.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.coalesce(stratum, F.lit(0)) == i).cast("int")).alias(f"s{i}") for i in slots]))
    total = sized.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in slots]).collect()[0]
    raw = [(r["split"], float(r["share_percent"])) for r in split_shares.collect() if r["share_percent"] and r["share_percent"] > 0]
    whole = sum(x for _, x in raw)
    shares = [(s, x / whole) for s, x in sorted(raw)]
    n, totals = total["n"] or 0, [total[f"s{i}"] or 0 for i in slots]
    if not shares or not n:
        return named.select("image_id", F.when(F.col("label") < PAPER, F.col("label")).alias("group_no"), "preset", F.lit(None).cast("string").alias("split"))
    limit = max(1.0, LARGE * n)
    big = [{"label": r["label"], "n": r["n"], "counts": [r[f"s{i}"] for i in slots]} for r in sized.filter(F.col("n") > limit).collect()]
    placed = _place(big, shares, totals)
    have = {s: [sum(b["counts"][i] for b in big if placed[b["label"]] == s) for i in slots] for s, _ in shares}

    lead = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("c"), F.lit(i).alias("i")) for i in slots]))["i"]
    small = sized.filter(F.col("n") <= limit).withColumn("lead", lead)
    mix = [F.col(f"s{i}").desc() for i in slots]
    small = positions(small, ["lead"], [F.col("n").desc(), *mix, F.col("label").asc()], "at")
    u = F.expr(f"pmod(at * {_GOLDEN}D + lead * 0.37D, 1D)")
    cases = F.lit(shares[-1][0])
    for i in slots:
        left = [max(0.0, share * totals[i] - have[s][i]) for s, share in shares]
        left = left if sum(left) > 0 else [share for _, share in shares]
        upto, inner = 0.0, F.lit(max(zip(left, [s for s, _ in shares], strict=True))[1])
        steps = []
        for x, (s, _) in zip(left, shares, strict=True):
            upto += x / sum(left)
            steps.append((upto, s))
        for bound, s in reversed(steps):
            inner = F.when(u < bound, F.lit(s)).otherwise(inner)
        cases = F.when(F.col("lead") == i, inner).otherwise(cases)
    chosen = small.select("label", cases.alias("split"))
    if placed:
        spark = features.sparkSession
        chosen = chosen.unionByName(spark.createDataFrame(list(placed.items()), "label long, split string"))
    out = named.withColumn("_key", key).join(chosen.withColumnRenamed("label", "_key"), "_key", "left")
    return out.select("image_id", F.when(F.col("label") < PAPER, F.col("label")).alias("group_no"), "preset", "split")


def balance(assigned: DataFrame) -> DataFrame:
    """(split, preset, images, share): how the images of each preset were divided."""
    by = assigned.groupBy("split", "preset").agg(F.count(F.lit(1)).alias("images"))
    per = by.groupBy("preset").agg(F.sum("images").alias("_all"))
    return join_same(by, per, ["preset"]).select("split", "preset", "images", F.round(F.col("images") / F.col("_all"), 4).alias("share"))
