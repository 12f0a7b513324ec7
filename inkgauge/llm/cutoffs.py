"""Cutoff keeping a target fraction (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import join_same, order_statistics
from ..session import settle

_BLANK = " \t\r\n"


def _source(name: str = "source"):
    return F.lower(F.trim(F.col(name), F.lit(_BLANK)))


def counting_rows(results: DataFrame) -> DataFrame:
    """One row per image: its latest result with a score from 0 to 1.

    Ties in ``analyzed_at`` (nulls count as earliest) go to the greatest
    ``result_id``. Null and NaN scores don't count. A row without an image id
    stands for itself. Sources are trimmed and in lower case; null sources and
    presets stay null and form no group that a target could name. Extra
    columns are ignored. The maximum is combined before the shuffle, so an
    image with very many rows costs no single task.
    """
    r = results.filter(F.col("score").between(0.0, 1.0))
    own = F.when(F.col("image_id").isNull(), F.col("result_id"))
    best = F.max(F.struct("analyzed_at", "result_id", "score", _source().alias("source"), F.col("preset").alias("preset")))
    return r.groupBy("image_id", own.alias("_own")).agg(best.alias("b")).select("b.result_id", "b.source", "b.preset", "b.score")


def cutoffs(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, preset, keep_percent, n, cutoff, kept) per group with a target.

    Scores are counted per (source, preset, score) first, which takes ties and
    hot groups out of the way; these counts are range sorted by source, preset
    and falling score, summed per partition and group, and the row that holds
    the target rank is read from the one partition that has it. A target of 0
    keeps the rows of the greatest score; one above 100 can't be met and gives
    no cutoff. Targets that fall together after trimming count as the largest.
    """
    group = ["source", "preset"]
    wanted = targets.filter(F.col("keep_percent").isNotNull()).groupBy(_source().alias("source"), "preset").agg(F.max("keep_percent").alias("keep_percent"))
    counts = settle(taken.filter(F.col("source").isNotNull() & F.col("preset").isNotNull()).groupBy(*group, "score").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    ranks = sizes.join(wanted, group).withColumn("rank", F.greatest(F.lit(1), F.expr("(keep_percent * n + 99) div 100")))
    at = order_statistics(counts, group, "score", "_n", ranks, descending=True).select(*group, F.col("score").alias("cutoff"))
    cut = ranks.drop("rank").join(at, group)
    kept = counts.join(at, group).filter(F.col("score") >= F.col("cutoff")).groupBy(*group).agg(F.sum("_n").alias("kept"))
    return cut.join(kept, group).select(*group, "keep_percent", "n", "cutoff", "kept")


def kept_rows(results: DataFrame, targets: DataFrame) -> DataFrame:
    """The results at or above their group's cutoff, with group and score."""
    taken = settle(counting_rows(results))
    cut = settle(cutoffs(taken, targets).select("source", "preset", "cutoff"))
    return join_same(taken, cut, ["source", "preset"]).filter(F.col("score") >= F.col("cutoff"))
