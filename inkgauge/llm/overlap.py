"""Same or near-same records across splits (problem 1).

A record's words are its width, its height and, for each of five measures, the
cell of a logarithmic grid that the value lies in. The seven words make one
n-gram. Evaluation records look their n-gram up under every cell that a value
within the tolerance may lie in (at most two a measure), training records are
scanned with the one n-gram they have, and hits are verified on the values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

MEASURES = ["brightnessAvg", "brightnessStdevMax", "laplacianStdev", "laplacianMean", "edgeRatio"]
VALUES = ["width", "height", *MEASURES]
TOLERANCE = 0.005
CELL = 8 * TOLERANCE
#: Records of a side and n-gram that are compared in one block; more are salted.
HOT = 4096


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _word(v: Column, shift: float) -> Column:
    """Grid cell of a value whose logarithm is moved by ``shift``; signs apart, zero for itself."""
    cell = F.floor((F.log(F.abs(v)) + F.lit(shift)) / F.lit(CELL)).cast("int")
    return F.when(v > 0, cell).when(v < 0, cell + F.lit(1 << 24)).otherwise(F.lit(-(1 << 24)))


def records(features: DataFrame) -> DataFrame:
    """Distinct (image_id, side, values) of rows that can take part.

    side 0 is train, 1 validation or test; other rows, rows without an image id
    and rows that lack a finite value of any compared column take no part.
    """
    split = F.lower(F.trim(F.col("split")))
    side = F.when(split == "train", 0).when(split.isin("validation", "test"), 1)
    ok = reduce(lambda a, b: a & b, (_finite(F.col(c)) for c in VALUES))
    rows = features.select("image_id", side.alias("side"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in VALUES])
    return rows.filter(F.col("side").isNotNull() & F.col("image_id").isNotNull() & ok).distinct()


def classes(recs: DataFrame) -> DataFrame:
    """Records of equal values on one side fall into a class, known by its values."""
    return recs.groupBy("side", *VALUES).agg(F.count(F.lit(1)).alias("images"))


def _gram(words: list[Column]) -> Column:
    return F.xxhash64("width", "height", *words)


def _salted(rows: DataFrame, hot: DataFrame, mine: str, other: str) -> DataFrame:
    """Rows of a hot n-gram in one of their own side's parts, repeated for each of the other side's."""
    n = lambda side: F.coalesce(F.col(f"{side}_parts"), F.lit(1))
    own = F.pmod(F.xxhash64(*[f"{mine}_{c}" for c in VALUES]), n(mine)).cast("int")
    joined = rows.join(hot, "gram", "left").withColumn(f"{mine}_salt", own)
    return joined.withColumn(f"{other}_salt", F.explode(F.sequence(F.lit(0), n(other) - 1))).drop("t_parts", "e_parts")


def class_links(cls: DataFrame) -> DataFrame:
    """Pairs of a training and an evaluation class that agree in all measures.

    Columns t_<value>, e_<value>, t_images, e_images and containment, the share
    of the evaluation record's seven words found in the training record (1.0
    for every row here, as all are verified). An n-gram with very many classes on
    a side is cut into a grid of blocks of about HOT x HOT comparisons; the table
    of such n-grams is joined as its written size allows.
    """
    train = cls.filter("side = 0").select(*[F.col(c).alias(f"t_{c}") for c in VALUES], F.col("images").alias("t_images"), _gram([_word(F.col(m), 0.0) for m in MEASURES]).alias("gram"))
    probes = cls.filter("side = 1")
    reach = -math.log(1 - TOLERANCE) * (1 + 1e-9) + 1e-12
    for i, m in enumerate(MEASURES):
        v = F.col(m)
        probes = probes.withColumn(f"_w{i}", F.explode(F.array_distinct(F.array(_word(v, -reach), _word(v, reach)))))
    probes = probes.select(*[F.col(c).alias(f"e_{c}") for c in VALUES], F.col("images").alias("e_images"), _gram([F.col(f"_w{i}") for i in range(len(MEASURES))]).alias("gram"))
    cells = train.select("gram", F.lit(1).alias("t"), F.lit(0).alias("e")).unionByName(probes.select("gram", F.lit(0).alias("t"), F.lit(1).alias("e"))).groupBy("gram").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
    parts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / HOT).cast("int")
    hot = settle(cells.filter((F.greatest("t", "e") > HOT) & (F.least("t", "e") > 0)).select("gram", parts("t").alias("t_parts"), parts("e").alias("e_parts")))
    train, probes = _salted(train, hot, "t", "e"), _salted(probes, hot, "e", "t")
    near = [F.abs(F.col(f"t_{m}") - F.col(f"e_{m}")) <= TOLERANCE * F.greatest(F.abs(F.col(f"t_{m}")), F.abs(F.col(f"e_{m}"))) for m in MEASURES]
    agree = reduce(lambda a, b: a & b, [F.col("t_width") == F.col("e_width"), F.col("t_height") == F.col("e_height"), *near])
    hits = train.join(probes, ["gram", "t_salt", "e_salt"]).filter(agree)
    share = (F.lit(2) + reduce(lambda a, b: a + b, [n.cast("int") for n in near])) / F.lit(float(len(VALUES)))
    return hits.drop("gram", "t_salt", "e_salt").withColumn("containment", share)


def _members(recs: DataFrame, links: DataFrame, side: int, prefix: str) -> DataFrame:
    wanted = links.select(*[F.col(f"{prefix}_{c}").alias(c) for c in VALUES]).distinct()
    return recs.filter(F.col("side") == side).join(wanted, VALUES, "left_semi").select(F.col("image_id").alias(f"{prefix}_image"), *[F.col(c).alias(f"{prefix}_{c}") for c in VALUES])


def _sided_pairs(features: DataFrame) -> DataFrame:
    """(t_image, e_image): a training image and an evaluation image with agreeing records; may repeat."""
    recs = settle(records(features))
    links = settle(class_links(classes(recs)).select(*[f"t_{c}" for c in VALUES], *[f"e_{c}" for c in VALUES]))
    pairs = links.join(_members(recs, links, 0, "t"), [f"t_{c}" for c in VALUES]).join(_members(recs, links, 1, "e"), [f"e_{c}" for c in VALUES])
    return pairs.select("t_image", "e_image").filter("t_image <> e_image")


def image_pairs(features: DataFrame) -> DataFrame:
    """(image_id_a, image_id_b), smaller first: every overlapping pair once.

    Null or empty input gives no pair; rows sent again and copies within a side
    change nothing, as equal rows are merged first.
    """
    pairs = _sided_pairs(features).select(F.least("t_image", "e_image").alias("image_id_a"), F.greatest("t_image", "e_image").alias("image_id_b"))
    return pairs.distinct()


def _owners(features: DataFrame) -> DataFrame:
    split = F.lower(F.trim(F.col("split")))
    return features.filter(split.isin("validation", "test") & F.col("image_id").isNotNull()).select("image_id", split.alias("split"), F.lower(F.trim(F.col("source"))).alias("source")).distinct()


def pair_counts(features: DataFrame) -> DataFrame:
    """(split, source, pairs): pairs of ``image_pairs`` per split and source of
    their evaluation image; 0 where no image of them occurs in train. An image
    of several splits or sources counts in each."""
    key = F.struct(F.least("t_image", "e_image"), F.greatest("t_image", "e_image"))
    pairs = _sided_pairs(features).select(F.col("e_image").alias("image_id"), key.alias("pair"))
    return _owners(features).join(pairs, "image_id", "left").groupBy("split", "source").agg(F.countDistinct("pair").alias("pairs"))


def report(features: DataFrame) -> DataFrame:
    """(split, source, images, overlapping): evaluation images per split and
    source, and how many of them occur in train. Works on classes, so copies
    are never paired with each other."""
    recs = settle(records(features))
    links = class_links(classes(recs)).select(*[F.col(f"e_{c}").alias(c) for c in VALUES]).distinct()
    hit = recs.filter("side = 1").join(links, VALUES, "left_semi").select("image_id").distinct().withColumn("hit", F.lit(1))
    counted = _owners(features).join(hit, "image_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("images"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))
    return counted


__all__ = ["MEASURES", "VALUES", "records", "classes", "class_links", "image_pairs", "pair_counts", "report"]
