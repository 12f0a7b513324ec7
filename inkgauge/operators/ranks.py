"""Ranks and order statistics within groups of any size.

A window over a whole group puts the group into one task. Here rows are range
sorted by (group, order) instead, so a group spreads over as many partitions
as it needs; counts per (partition, group) are summed in front of each
partition, which places every row without moving it again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Null-safe equality on ``cols``."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in cols))


def join_same(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality, keeping the left side's key columns."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols))
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def range_sorted(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Range sort and settle ``df``; return it with ``_part`` and ``_slot``, and
    the table of partitions: (group, _part, _first, _rows, _w, _before)."""
    keys = [F.col(g).asc_nulls_first() for g in group] + list(order)
    rows = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_slot", 33))
    w = F.sum(weight) if weight else F.count(F.lit(1))
    parts = rows.groupBy(*group, "_part").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"), w.alias("_w"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row within its group.

    ``order`` must be total (end it with a unique column), so that a hot value
    can be cut between partitions. Null group values form a group.
    """
    rows, parts = range_sorted(df, group, order)
    placed = join_same(rows, parts.select(*group, "_part", "_first", "_before"), [*group, "_part"])
    return placed.withColumn(out, F.col("_before") + F.col("_slot") - F.col("_first")).drop("_slot", "_part", "_first", "_before")


def order_statistics(counts: DataFrame, group: Sequence[str], value: str, weight: str, ranks: DataFrame, descending: bool = False) -> DataFrame:
    """The value at given 1-based ranks of each group, ties counted by weight.

    ``counts`` has one row per distinct (group, value) with its ``weight``;
    ``ranks`` has the group columns and ``rank``. Only the partitions that hold
    a wanted rank are read for the running sums. Returns ``ranks`` with
    ``value``; ranks outside 1..n give no row.
    """
    c = F.col(value)
    rows, parts = range_sorted(counts, group, [c.desc() if descending else c.asc()], weight)
    parts = parts.select(*group, "_part", "_w", "_before")
    hits = join_same(ranks.select(*group, "rank").distinct(), parts, group).filter((F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("_w"))).drop("_w")
    near = join_same(rows.select(*group, value, weight, "_slot", "_part"), hits.select(*group, "_part", "_before").distinct(), [*group, "_part"])
    run = Window.partitionBy(*group, "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_upto", F.col("_before") + F.sum(weight).over(run)).withColumn("_over", F.col("_upto") - F.col(weight)).drop("_before", weight, "_slot")
    found = join_same(hits.drop("_before"), near, [*group, "_part"])
    return found.filter((F.col("_over") < F.col("rank")) & (F.col("rank") <= F.col("_upto"))).select(*group, "rank", value)
