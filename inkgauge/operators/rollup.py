"""Roll-ups and side tables: pages, tiers, labels, model quality, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CATEGORY_PRESETS, GUIDANCE, PRESETS, THRESHOLDS
from ..functions.scalar import confidence, half_up, label_tier, threshold, tier_label
from .ranks import positions


def pages(judged: DataFrame, doc: str = "doc_id", page: str = "page", overrides: dict | None = None) -> DataFrame:
    """One row per document from one row per page (score, pass, preset, issues).

    The score is the rounded mean, a document passes when all pages do, the
    preset is that of the first worst page (document when there is no issue).
    Pages are unordered in the aggregate and sorted within the result row.
    """
    worst = F.min_by(F.col("preset"), F.struct("score", page))
    issues = F.transform(F.col("issues"), lambda i: i.withField("page", F.col(page).cast("int")))
    by = judged.withColumn("_i", issues).groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), "pass", "score", F.col("_i").alias("issues")))).alias("pageResults"),
        F.every("pass").alias("pass"), half_up(F.min("score")).alias("worstPageScore"),
        worst.alias("_worst"), F.sum(F.size("_i")).alias("_n"),
    )
    total = F.aggregate("pageResults", F.lit(0.0), lambda a, p: a + p["score"])  # in page order, so that ties in rounding are stable
    by = by.withColumn("score", half_up(total / F.size("pageResults"))).withColumn("preset", F.when(F.col("_n") > 0, F.col("_worst")).otherwise("document")).withColumn("issues", F.flatten(F.transform("pageResults", lambda p: p["issues"])))
    return by.withColumn("confidence", confidence(F.col("score"), threshold("passThreshold", F.col("preset"), overrides))).drop("_worst", "_n")


def path_parts(path: Column) -> tuple[Column, Column]:
    """Category and tier folder of a path, in any spelling of separators; null where absent."""
    plain = F.lower(F.regexp_replace(path, r"[\\/]+(\./)?", "/"))
    cut = lambda i: F.nullif(F.regexp_extract(plain, r"(?:^|/)(documents|receipts|cards|photos)/(very-good|good|very-bad|bad|unsorted)/", i), F.lit(""))
    return cut(1), cut(2)


def category_preset(category: Column) -> Column:
    out = None
    for c, p in CATEGORY_PRESETS.items():
        out = F.when(category == c, p) if out is None else out.when(category == c, p)
    return out


def tier_summary(results: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    """Count, passes, failures, errors and scores per tier; with ``cube`` also the sub-totals (rollup)."""
    ok = F.col("error").isNull()
    score = F.when(ok & ~F.isnan("score"), F.col("score"))
    grouped = results.rollup(*by) if cube else results.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok & F.col("pass")).alias("passed"), F.count_if(ok & ~F.col("pass")).alias("failed"), F.count_if(~ok).alias("errors"), F.avg(score).alias("avg_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The last record per path (greatest time, then greatest id): upsert semantics."""
    best = F.max(F.struct("labeled_at", "label_id", "label", "score", "category"))
    return labels.filter("path is not null").groupBy("path").agg(best.alias("b")).select("path", "b.label", "b.score", "b.category", "b.label_id")


def labelled(images: DataFrame, labels: DataFrame, tier: Column) -> DataFrame:
    """Images with their label: the recorded score, else the recorded tier's default, else the folder's; null last."""
    joined = images.join(latest_labels(labels).select("path", F.col("score").alias("_s"), F.lower(F.trim("label")).alias("_l")), "path", "left")
    usable = F.when(F.col("_s").between(0.0, 1.0), F.col("_s"))
    return joined.withColumn("label", F.coalesce(usable, tier_label(F.col("_l")), tier_label(tier))).drop("_s", "_l")


def regression_metrics(scored: DataFrame, truth: str = "label", guess: str = "score", by: list[str] = ()) -> DataFrame:
    """n, mae, rmse, r2 of guesses clipped to 0..1."""
    y, p = F.col(truth), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(guess)))
    d = scored.filter(y.isNotNull() & ~F.isnan(y) & F.col(guess).isNotNull() & ~F.isnan(guess)).select(*by, y.alias("y"), (y - p).alias("e"))
    e = F.col("e")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))).alias("r2"))


def confusion(scored: DataFrame, truth: str = "label", guess: str = "score", at: float = 0.5) -> DataFrame:
    t, p = F.col(truth) >= at, F.col(guess) >= at
    ok = scored.filter(F.col(truth).isNotNull() & ~F.isnan(truth) & F.col(guess).isNotNull() & ~F.isnan(guess))
    return ok.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), (F.count_if(t == p) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("accuracy"))


def by_tier(scored: DataFrame, truth: str = "label", guess: str = "score") -> DataFrame:
    t, p = F.col(truth) >= 0.5, F.col(guess) >= 0.5
    d = scored.filter(F.col(truth).isNotNull() & ~F.isnan(truth) & F.col(guess).isNotNull() & ~F.isnan(guess)).withColumn("tier", label_tier(F.col(truth))).filter("tier is not null")
    return d.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), (F.count_if(t == p) / F.count(F.lit(1))).alias("accuracy"))


def worst(scored: DataFrame, key: str, k: int = 5, truth: str = "label", guess: str = "score") -> DataFrame:
    """The k rows with the largest error: a top-k report."""
    e = F.abs(F.col(truth) - F.col(guess))
    return scored.filter(e.isNotNull() & ~F.isnan(e)).select(key, truth, guess, F.round(e, 9).alias("error")).orderBy(F.desc("error"), key).limit(k)


def stratified_split(paths: DataFrame, seed: int = 42, test_share: float = 0.15) -> DataFrame:
    """(path, tier, test): a seeded share of every tier's paths, each path once.

    The decision is a threshold on a hash of the path, so it needs no sort and
    no state: a path keeps its side however many rows are added. The tiers are
    right-closed quarters; a label of exactly 0 falls in none and is left out.
    """
    one = paths.filter("path is not null and label is not null and not isnan(label)").groupBy("path").agg(F.min("label").alias("label"))
    y = F.col("label")
    tier = F.when((y > 0) & (y <= 0.25), "very-bad").when((y > 0.25) & (y <= 0.5), "bad").when((y > 0.5) & (y <= 0.75), "good").when((y > 0.75) & (y <= 1.0), "very-good")
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("path"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(10000))
    return one.withColumn("tier", tier).filter("tier is not null").select("path", "tier", (draw < int(test_share * 10000)).alias("test"))


def first_labels(rows: DataFrame) -> DataFrame:
    """One label per path: that of the first mode in order, then the first row."""
    return rows.filter("label is not null and not isnan(label)").groupBy("path").agg(F.min_by("label", F.struct("mode", "row_id")).alias("label"))


def ocr_confidence(words: DataFrame, doc: str = "doc_id", least: int = 5, low: float = 60.0) -> DataFrame:
    """(doc, words, median, low_words, fires): documents of fewer words are left out."""
    by = words.groupBy(doc).agg(F.count("confidence").alias("words"), F.percentile("confidence", 0.5).alias("median"), F.count_if(F.col("confidence") < low).alias("low_words"))
    return by.filter(F.col("words") >= least).withColumn("fires", F.col("median") < low)


def monotone_violations(quick: DataFrame, full: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that the quick check rejects although the full check passes them.

    The full check's rows are summed up by image before they are filtered: a
    filter on ``pass`` itself would be moved below the rules, with all their
    conditions written out for each bit that the score reads.
    """
    passed = full.groupBy(key).agg(F.bool_or("pass").alias("_passed")).filter("_passed").select(key)
    return quick.filter(~F.col("pass")).select(key).distinct().join(passed, key, "left_semi")


def threshold_table(spark) -> DataFrame:
    """(preset, name, value) of all presets: 3 x 39 fixed rows."""
    return spark.createDataFrame([(p, n, float(PRESETS[p].get(n, v))) for p in PRESETS for n, v in THRESHOLDS.items()], "preset string, name string, value double")


def guidance_table(spark) -> DataFrame:
    return spark.createDataFrame(list(GUIDANCE.items()), "code string, guidance string")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Seeded order that doesn't depend on partitions."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))), key)


def shuffle_places(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Every row with its ``place`` from 1 in the order of ``shuffled``; ``key`` is unique."""
    placed = positions(df, [], [F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))).asc(), F.col(key).asc()], "place")
    return placed.withColumn("place", F.col("place") + 1)


def _sort_key(df: DataFrame, col: str, descending: bool) -> Column:
    c = F.lower(col) if dict(df.dtypes)[col] == "string" else F.col(col)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def sorted_by(df: DataFrame, col: str, descending: bool = False, then: str | None = None) -> DataFrame:
    """Order by any column, text without case, nulls last; ``then`` settles ties."""
    return df.orderBy(_sort_key(df, col, descending), *([then] if then else []))


def sorted_places(df: DataFrame, col: str, then: str, descending: bool = False) -> DataFrame:
    """Every row with its ``place`` from 1 in the order of ``sorted_by``; ``then`` is unique."""
    placed = positions(df, [], [_sort_key(df, col, descending), F.col(then).asc()], "place")
    return placed.withColumn("place", F.col("place") + 1)


def first_unlabelled(images: DataFrame, key: str) -> DataFrame:
    return images.filter(F.col("label").isNull()).orderBy(key).limit(1)


def largest(parts: DataFrame, by: str, k: int = 5000) -> DataFrame:
    """The k largest parts of each image, first-seen first among equals."""
    w = Window.partitionBy(by).orderBy(F.desc("area"), "label")
    return parts.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= k).drop("_no")
