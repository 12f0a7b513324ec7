"""Column-level data quality profile (problem 5).

Columns are unpivoted and counted per (column, load, value); everything else
(null rates, distincts, ranges, medians, impossible cells, changes between
loads) is read off these counts, which are far fewer than cells where values
repeat and are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .ranks import join_same, order_statistics

INF = float("inf")
NULL_STEP, MEDIAN_LOW, MEDIAN_HIGH, DISTINCT_LEAST = 0.2, 0.65, 1.5, 4


@dataclass(frozen=True)
class Check:
    """What a column may hold: its range, ends included, and whether only thorough rows have it."""

    low: float = -INF
    high: float = INF
    thorough: bool = False


CHECKS = {"brightnessAvg": Check(0, 255), "fftHighFreqRatio": Check(0, 1, True), "zoneSharpness0": Check(0, 127.5, True)}

_SHARE, _GREY, _ANY = Check(0, 1), Check(0, 255), Check(0)
_FAST = {"megapixels": _ANY, "width": _ANY, "height": _ANY, "aspectRatio": _ANY, "fileSize": _ANY, "bpp": _ANY, "brightnessAvg": _GREY, "brightnessStdevMax": Check(0, 127.5), "laplacianStdev": Check(0, 127.5), "laplacianMean": _GREY, "laplacianVariance": _ANY, "edgeRatio": _SHARE, "dpi": _ANY, "isJpeg": _SHARE, "presetIdx": Check(0, 2)}
_SLOW = {
    "foregroundRatio": (0, 1), "sharpnessRatioTopBot": (1, INF), "brightnessDiffTopBot": (0, 255), "shadowEdgeCenterDiff": (-255, 255), "centerBrightness": (0, 255), "edgeBrightness": (0, 255),
    "backgroundP90": (0, 255), "skewAngle": (0, 90), "colorSaturation": (0, 1), "fftHighFreqRatio": (0, 1), "fftSpectralPeaks": (0, INF), "fftJpegBlockiness": (0, INF), "zoneBrightnessDiff": (0, 255),
    "zoneSharpnessRatio": (0, 1), "directionalEnergyRatio": (0, INF), "zoneBrightness0": (0, 255), "zoneBrightness1": (0, 255), "zoneBrightness2": (0, 255), "zoneBrightness3": (0, 255),
    "zoneSharpness0": (0, 127.5), "zoneSharpness1": (0, 127.5), "zoneSharpness2": (0, 127.5), "zoneSharpness3": (0, 127.5), "channelCount": (1, INF), "textBaselineDeviation": (0, INF), "textCharSizeCV": (0, INF), "textCharShapeCV": (0, INF),
}
#: Ranges that the features' definitions imply, in the fixed order of the feature vector.
ALL_CHECKS = _FAST | {c: Check(low, high, True) for c, (low, high) in _SLOW.items()}


def columns_of(df: DataFrame) -> tuple[dict[str, Check], list[str]]:
    """Every column of ``df``: those that are numbers or times with their check, and the texts.

    A column without a range of its own may hold any finite number. Numbers are
    compared as DOUBLE, so integers are told apart up to 2^53.
    """
    texts = [c for c, kind in df.dtypes if kind == "string"]
    known = ALL_CHECKS | {"label": _SHARE}
    return {c: known.get(c, Check()) for c in df.columns if c not in texts}, texts


def _mode() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("mode"), F.lit(""))))


def _number(df: DataFrame, c: str) -> Column:
    """The column as DOUBLE; times without zone are seconds since 1970, whatever the session's zone."""
    v = F.col(c)
    if df.schema[c].dataType.typeName() != "timestamp_ntz":
        return v.cast("double")
    return F.unix_date(v.cast("date")) * 86400.0 + F.hour(v) * 3600 + F.minute(v) * 60 + F.extract(F.lit("second"), v).cast("double")


def cells(df: DataFrame, checks: dict[str, Check], extra: list[str]) -> DataFrame:
    """One row per cell: (extra, load_id, mode, column_name, value as DOUBLE).

    Infinite bounds never exclude a finite value. Only the named columns are
    read; clashing names of other columns don't matter.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _number(df, c).alias("value"), F.lit(float(k.low)).alias("low"), F.lit(float(k.high)).alias("high"), F.lit(k.thorough).alias("thorough")) for c, k in checks.items()])
    return df.select(*extra, "load_id", _mode().alias("_mode"), F.explode(pairs).alias("c")).select(*extra, "load_id", "_mode", "c.*")


def _in_range(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(INF)) & (v >= F.col("low")) & (v <= F.col("high"))


def _due() -> Column:
    return ~F.col("thorough") | (F.col("_mode") == "thorough")


def bad_cells(df: DataFrame, checks: dict[str, Check] = CHECKS) -> DataFrame:
    """(column_name, load_id, row_id) of cells that are not null and are NaN,
    infinite, outside the range, or filled in a fast row of a thorough column."""
    c = cells(df, checks, ["row_id"])
    v = F.col("value")
    return c.filter(v.isNotNull() & (~_in_range(v) | (F.col("thorough") & (F.col("_mode") == "fast")))).select("column_name", "load_id", "row_id").distinct()


def value_counts(df: DataFrame, checks: dict[str, Check] = CHECKS) -> DataFrame:
    """(column_name, load_id, value, good, n) of due cells; null values have a row too."""
    c = cells(df, checks, []).filter(_due())
    return c.groupBy("column_name", "load_id", "value", _in_range(F.col("value")).alias("good")).agg(F.count(F.lit(1)).alias("n"))


def text_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, load_id, value as STRING, n) of text columns; null values have a row too."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names])
    return df.select("load_id", F.explode(pairs).alias("c")).groupBy("c.column_name", "load_id", "c.value").agg(F.count(F.lit(1)).alias("n"))


def medians(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, median) of counted values: the middle, or the mean of the two middles."""
    n = counts.groupBy(*group).agg(F.sum("n").alias("n"))
    ranks = n.select(*group, F.explode(F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))).alias("rank"))
    return order_statistics(counts.select(*group, "value", "n"), group, "value", "n", ranks).groupBy(*group).agg(F.avg("value").alias("median"))


def load_profile(counts: DataFrame) -> DataFrame:
    """(column_name, load_id, due, nulls, in_range, distinct_in_range, low, high, median)."""
    group = ["column_name", "load_id"]
    good = F.col("good")
    by = counts.groupBy(*group).agg(F.sum("n").alias("due"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("in_range"), F.count_if(good).alias("distinct_in_range"), F.min(F.when(good, F.col("value"))).alias("low"), F.max(F.when(good, F.col("value"))).alias("high"))
    return join_same(by, medians(counts.filter(good), group), group, "left")


def bad_loads(profile: DataFrame) -> DataFrame:
    """(column_name, load_id, nulls_up, median_off, few_values) of loads where one holds.

    Compares each load with the medians over all loads: the share of nulls is
    more than 0.2 above, the median is below 0.65 or above 1.5 times; or the
    values in range have fewer distinct ones than a quarter of their number.
    The profile has a row per column and load, so the medians over loads are
    taken on that small table. A load without a due row, or whose values are
    all null or impossible, has no median and fails no rule on it.
    """
    share = F.col("nulls") / F.nullif("due", F.lit(0))
    p = profile.withColumn("share", share)
    over = p.groupBy("column_name").agg(F.percentile("share", 0.5).alias("_share"), F.percentile("median", 0.5).alias("_median"))
    p = p.join(over, "column_name")
    up = F.coalesce(F.col("share") > F.col("_share") + NULL_STEP, F.lit(False))
    off = F.coalesce((F.col("median") < MEDIAN_LOW * F.col("_median")) | (F.col("median") > MEDIAN_HIGH * F.col("_median")), F.lit(False))
    few = F.coalesce(F.col("distinct_in_range") * DISTINCT_LEAST < F.col("in_range"), F.lit(False))
    flags = p.select("column_name", "load_id", up.alias("nulls_up"), off.alias("median_off"), few.alias("few_values"))
    return flags.filter("nulls_up or median_off or few_values")


def found(df: DataFrame, checks: dict[str, Check] = CHECKS) -> DataFrame:
    """(column_name, load_id, row_id): bad cells, and bad loads with row_id 0."""
    counts = settle(value_counts(df, checks))
    loads = bad_loads(load_profile(counts)).select("column_name", "load_id", F.lit(0).cast("long").alias("row_id"))
    return bad_cells(df, checks).unionByName(loads)


def profile(df: DataFrame, checks: dict[str, Check]) -> DataFrame:
    """Whole-column profile over all loads: (column_name, due, nulls, distincts,
    in_range, low, high, impossible). Exact, from the value counts."""
    counts = cells(df, checks, []).groupBy("column_name", "value", _in_range(F.col("value")).alias("good"), _due().alias("due")).agg(F.count(F.lit(1)).alias("n"))
    v, n, due = F.col("value"), F.col("n"), F.col("due")
    return counts.groupBy("column_name").agg(
        F.sum(F.when(due, n).otherwise(0)).alias("due"),
        F.sum(F.when(due & v.isNull(), n).otherwise(0)).alias("nulls"),
        F.count_if(due & F.col("good")).alias("distincts"),
        F.sum(F.when(due & F.col("good"), n).otherwise(0)).alias("in_range"),
        F.min(F.when(due & F.col("good"), v)).alias("low"),
        F.max(F.when(due & F.col("good"), v)).alias("high"),
        F.sum(F.when(v.isNotNull() & (~F.col("good") | ~due), n).otherwise(0)).alias("impossible"),
    )


def text_profile(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, due, nulls, distincts, low_text, high_text) from ``text_counts``; every value is in range."""
    v, n = F.col("value"), F.col("n")
    by = counts.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    return by.groupBy(*group).agg(F.sum("n").alias("due"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulls"), F.count("value").alias("distincts"), F.min("value").alias("low_text"), F.max("value").alias("high_text"))


def profile_all(df: DataFrame) -> DataFrame:
    """``profile`` of every column of ``df``; text columns have their first and last value in low_text and high_text."""
    checks, texts = columns_of(df)
    out = profile(df, checks)
    if texts:
        text = text_profile(text_counts(df, texts), ["column_name"]).withColumns({"in_range": F.col("due") - F.col("nulls"), "impossible": F.lit(0).cast("long")})
        out = out.unionByName(text, allowMissingColumns=True)
    return out


def loads_all(df: DataFrame) -> DataFrame:
    """``load_profile`` of every column of ``df`` and each load, texts as in ``profile_all``."""
    checks, texts = columns_of(df)
    out = load_profile(settle(value_counts(df, checks)))
    if texts:
        text = text_profile(text_counts(df, texts), ["column_name", "load_id"]).withColumn("in_range", F.col("due") - F.col("nulls"))
        out = out.unionByName(text.withColumnRenamed("distincts", "distinct_in_range"), allowMissingColumns=True)
    return out


def drift(df: DataFrame, checks: dict[str, Check] = CHECKS, bins: int = 10, texts: Sequence[str] = ()) -> DataFrame:
    """(column_name, load_id, n, psi, chi_square): each load against all others before it together.

    Bins of a number are ``bins`` equal steps of the column's whole range in the
    table (they need no sort); each value of a text column is a bin of its own
    once it has occurred. The reference is the sum of the earlier loads. Empty
    bins count as half a value. The first load has no reference and gives no
    row. Nulls are left out; ``load_profile`` has them.
    """
    c = cells(df, checks, []).filter(_due() & _in_range(F.col("value"))).select("column_name", "load_id", "value")
    span = settle(c.groupBy("column_name").agg(F.min("value").alias("a"), F.max("value").alias("z")))
    step = F.when(F.col("z") > F.col("a"), F.least(F.floor((F.col("value") - F.col("a")) / (F.col("z") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = c.join(F.broadcast(span), "column_name").groupBy("column_name", "load_id", step.cast("string").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if texts:
        counts = counts.unionByName(text_counts(df, texts).filter("value is not null").withColumnRenamed("value", "bin"))
    return _shifts(settle(counts), list(checks), bins)


def _shifts(counts: DataFrame, numbers: list[str], bins: int) -> DataFrame:
    """``drift`` from (column_name, load_id, bin, n); the columns in ``numbers`` have ``bins`` bins.

    Bins of a load with equal counts here and before give the same term, so
    they are counted by the pair. A bin that a load leaves empty has no row;
    it is counted from the load it was filled in up to the next that fills it,
    and loads aren't multiplied by values.
    """
    at = Window.partitionBy("column_name").orderBy("load_id")
    loads = settle(counts.select("column_name", "load_id").distinct().withColumn("_at", F.row_number().over(at)))
    own = Window.partitionBy("column_name", "bin").orderBy("_at")
    t = join_same(counts, loads, ["column_name", "load_id"]).select("column_name", "bin", "n", "_at")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = settle(t.select("column_name", "_at", F.col("n").alias("h"), before.alias("r"), F.lead("_at").over(own).alias("_to")).groupBy("column_name", "_at", "h", "r", "_to").agg(F.count(F.lit(1)).alias("k")))
    gone = t.groupBy("column_name", F.col("_at").alias("_from"), (F.col("h") + F.col("r")).alias("r"), "_to").agg(F.sum("k").alias("k"))
    gone = gone.join(loads.select("column_name", "_at"), "column_name").filter("_at > _from and (_to is null or _at < _to)")
    pairs = t.select("column_name", "_at", "h", "r", "k").unionByName(gone.select("column_name", "_at", F.lit(0).cast("long").alias("h"), "r", "k"))
    pairs = pairs.filter("_at > 1").groupBy("column_name", "_at", "h", "r").agg(F.sum("k").alias("k"))
    unseen = pairs.filter(F.col("column_name").isin(numbers)).groupBy("column_name", "_at").agg((F.lit(bins) - F.sum("k")).alias("k")).select("column_name", "_at", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("r"), "k")
    pairs = settle(pairs.unionByName(unseen))
    k, here, there = F.col("k"), F.greatest(F.col("h").cast("double"), F.lit(0.5)), F.greatest(F.col("r").cast("double"), F.lit(0.5))
    sums = pairs.groupBy("column_name", "_at").agg(F.sum(k * here).alias("sh"), F.sum(k * there).alias("sr"), F.sum(k * F.col("h")).alias("n"))
    share, past, due = here / F.col("sh"), there / F.col("sr"), there * F.col("sh") / F.col("sr")
    out = pairs.join(sums, ["column_name", "_at"]).groupBy("column_name", "_at").agg(F.first("n").alias("n"), F.sum(k * (share - past) * F.log(share / past)).alias("psi"), F.sum(k * (here - due) * (here - due) / due).alias("chi"))
    return out.join(loads, ["column_name", "_at"]).select("column_name", "load_id", "n", F.round("psi", 6).alias("psi"), F.round("chi", 3).alias("chi_square"))


__all__ = ["ALL_CHECKS", "CHECKS", "Check", "bad_cells", "bad_loads", "columns_of", "drift", "found", "load_profile", "loads_all", "medians", "profile", "profile_all", "text_counts", "text_profile", "value_counts"]
