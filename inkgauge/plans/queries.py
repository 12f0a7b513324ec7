"""Registered queries of the core. Their SQL is in ``oracles``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.constants import FEATURES, PREFLIGHT_FEATURES
from ..operators import degrade, kernels, models, pixels, rollup, rules
from ..operators import profile as prof
from ..session import spread, table
from ..streaming import uploads
from .oracles import SQL

FLAGSHIP = "features_judged"


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ── inputs derived from the tables ───────────────────────────────────────────
def meta(spark, d) -> DataFrame:
    """Image facts derived from documents: sizes from ids, a format from the language."""
    doc = table(spark, d, "documents")
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("und"))))
    fmt = F.when(lang == "en", "jpeg").when(lang == "de", "png").when(lang == "fr", "tiff").otherwise("webp")
    return doc.select(F.col("doc_id").alias("image_id"), (300 + F.col("doc_id") * 37 % 2900).cast("int").alias("width"), (300 + F.col("doc_id") * 53 % 3700).cast("int").alias("height"), (F.coalesce("n_chars", F.lit(0)) * 50).alias("file_size"), fmt.alias("format"), (72 + 37 * (F.col("doc_id") % 8)).cast("double").alias("density"))


def text_px(spark, d) -> DataFrame:
    return pixels.text_rasters(table(spark, d, "documents").select("doc_id", "text"))


def vector_px(spark, d) -> DataFrame:
    return pixels.vector_rasters(table(spark, d, "embeddings"))


def text_images(spark, d) -> DataFrame:
    """The same byte rasters as one binary cell per text."""

    @F.pandas_udf("binary")
    def shade(raw: pd.Series) -> pd.Series:
        tone = bytes(240 if b <= 32 else 2 * (b % 64) for b in range(256))
        return raw.map(lambda b: None if b is None else bytes(b)[: len(b) // 128 * 128].translate(tone))

    doc = spread(table(spark, d, "documents").select("doc_id", "text").filter("octet_length(text) >= 128"), "doc_id")
    height = F.expr("cast(octet_length(text) div 128 as int)")
    return doc.select(F.col("doc_id").alias("image_id"), F.lit(128).alias("width"), height.alias("height"), F.lit(1).alias("n_channels"), shade(F.encode("text", "UTF-8")).alias("data"), F.octet_length("text").cast("long").alias("file_size"), F.lit("jpeg").alias("format"), F.lit(300.0).alias("density"))


def _features(spark, d) -> DataFrame:
    return table(spark, d, "features").withColumn("mode", F.lower(F.trim("mode")))


def _judged(spark, d, **options) -> DataFrame:
    f = _features(spark, d)
    return rules.judge(f, mode=F.col("mode"), **options)


# ── rules and scores ─────────────────────────────────────────────────────────
def features_judged(spark, d):
    """Every feature row through all rules: the flagship."""
    return _judged(spark, d).select("row_id", "preset", "n_issues", "codes", "score", "pass", "confidence")


def meta_rules_fast(spark, d):
    j = rules.judge(rules.metadata_metrics(meta(spark, d)))
    return j.select("image_id", "preset", "codes", "score", "pass", "confidence")


def preset_detect(spark, d):
    return meta(spark, d).select("image_id", S.detect_preset(F.col("width"), F.col("height")).alias("preset"))


def threshold_resolve(spark, d):
    """Thresholds of each row's preset by a join with the fixed table of 117 rows."""
    t = rollup.threshold_table(spark).filter("name in ('brightnessMin', 'passThreshold', 'fileSizeMin')").withColumnRenamed("preset", "_p")
    m = meta(spark, d).withColumn("preset", S.detect_preset(F.col("width"), F.col("height")))
    return m.join(F.broadcast(t), m.preset == t._p).groupBy("preset", "name").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("images"))


def score_penalty_override(spark, d):
    """User penalties (by analyzer) and thresholds in place of the defaults."""
    j = _judged(spark, d, penalties={"brightness": 0.9, "shadow": 0.5}, overrides={"sharpnessMin": 10.0, "passThreshold": 0.7})
    return j.groupBy("preset", "mode", "pass").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score_sum"))


def custom_rule(spark, d):
    """A registered rule of the user's beside the fixed ones."""
    mine = rules.custom_issue(F.col("aspectRatio") > 1.5, "wide", F.col("aspectRatio"), F.lit(1.5), 0.8)
    j = _judged(spark, d, extra=[mine])
    return j.groupBy("preset").agg(F.sum(F.size(F.filter("issues", lambda i: i["code"] == "custom"))).cast("long").alias("custom"), F.round(F.sum("score"), 2).alias("score_sum"))


def issue_counts(spark, d):
    return rules.issue_totals(_judged(spark, d), "preset")


def issues_exploded(spark, d):
    """The issue relation of the recorded results."""
    r = table(spark, d, "results").select("result_id", F.posexplode("issues").alias("no", "i"))
    return r.select("result_id", "no", "i.analyzer", "i.code", "i.value", "i.threshold", "i.penalty", "i.page")


def guidance_lookup(spark, d):
    """Advice per recorded code; codes without advice get the general one."""
    i = table(spark, d, "results").select(F.explode("issues").alias("i")).groupBy("i.code").agg(F.count(F.lit(1)).alias("n"))
    return i.join(F.broadcast(rollup.guidance_table(spark)), "code", "left").select("code", "n", F.col("guidance").isNotNull().alias("known"))


def score_product(spark, d):
    """Recorded issues' penalties multiplied again, with the confidence band."""
    r = table(spark, d, "results").filter("error is null and issues is not null")
    s = S.half_up(rules.product(F.col("issues")))
    return r.select("result_id", s.alias("product"), S.confidence(s, S.threshold("passThreshold", F.col("preset"))).alias("confidence"))


def confidence_band(spark, d):
    r = table(spark, d, "results").filter(F.col("score").between(0.0, 1.0))
    return r.groupBy("preset", S.confidence(F.col("score"), S.threshold("passThreshold", F.col("preset"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def scorer_fallback(spark, d):
    """A scorer that is absent, NaN or infinite for some rows falls back to the product."""
    ml = F.when(F.col("row_id") % 5 == 0, F.lit(None).cast("double")).when(F.col("row_id") % 5 == 1, F.lit(float("nan"))).when(F.col("row_id") % 5 == 2, F.lit(1.7)).when(F.col("row_id") % 5 == 3, F.lit(-3.0)).otherwise(0.456)
    return _judged(spark, d, scorer=ml).select("row_id", "score", "pass")


# ── pixel relation ───────────────────────────────────────────────────────────
def channel_stats(spark, d):
    return pixels.channel_stats(text_px(spark, d)).select("image_id", "n", _r("mean"), _r("stdev"))


def text_contrast(spark, d):
    return pixels.foreground(text_px(spark, d)).select("image_id", _r("foreground"))


def histogram_p90(spark, d):
    return pixels.histogram_p90(text_px(spark, d))


def half_split(spark, d):
    return pixels.half_split(text_px(spark, d)).select("image_id", _r("top"), _r("bottom"), _r("diff"), _r("ratio", 4))


def edge_center_shadow(spark, d):
    return pixels.edge_centre(text_px(spark, d)).select("image_id", _r("edge"), _r("centre"), _r("diff"))


def quadrant_zones(spark, d):
    return pixels.zones(text_px(spark, d)).select("image_id", *[_r(c) for c in ("z0", "z1", "z2", "z3", "spread")])


def laplacian_stats(spark, d):
    return pixels.laplacian_stats(text_px(spark, d)).select("image_id", _r("mean"), _r("stdev"), _r("edge_ratio"))


def jpeg_blockiness(spark, d):
    return pixels.blockiness(text_px(spark, d)).select("image_id", _r("blockiness"))


def skew_regression(spark, d):
    return pixels.skew(pixels.laplacian(vector_px(spark, d))).select("image_id", _r("angle"))


def row_clusters(spark, d):
    """Runs of dark pixels in rows by gaps of their height (gaps and islands)."""
    return pixels.row_clusters(pixels.runs(vector_px(spark, d)).filter("area >= 3"), F.lit(1.0)).groupBy("image_id", "row_no").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("first_y"), F.max("y").alias("last_y"))


def baseline_deviation(spark, d):
    r = pixels.row_clusters(pixels.runs(vector_px(spark, d)).filter("area >= 3"), F.lit(1.0))
    return pixels.baseline_deviation(r).select("image_id", _r("residual"), "lines")


def largest_parts(spark, d):
    """The k largest runs of each raster, first-seen first among equals (a top-k report)."""
    return rollup.largest(pixels.runs(text_px(spark, d)), "image_id", 5).select("image_id", "label", "area")


def boundary_scan(spark, d):
    return pixels.first_rise(text_px(spark, d))


def area_average(spark, d):
    return pixels.area_average(vector_px(spark, d), 50).select("image_id", "x", "y", (F.floor(F.col("g") * 1000 + 0.317) / 1000).alias("g"))  # an offset off any tie


def color_saturation(spark, d):
    """Spread of three channel means; the channels are the raster's columns by thirds."""
    p = text_px(spark, d).withColumn("c", F.col("x") % 3)
    m = p.groupBy("image_id").agg(*[F.avg(F.when(F.col("c") == i, F.col("g"))).alias(f"m{i}") for i in range(3)])
    cols = [F.col(f"m{i}") for i in range(3)]
    return m.select("image_id", F.round((F.greatest(*cols) - F.least(*cols)) / 255, 6).alias("saturation"))


def scalar_functions(spark, d):
    m = meta(spark, d)
    w, h = S.fit_inside(F.col("width"), F.col("height"), 200)
    return m.select("image_id", S.half_up(S.megapixels(F.col("width"), F.col("height"))).alias("mp"), w.alias("tw"), h.alias("th"), S.next_pow2(F.col("width")).alias("p2"), F.round(S.hann(F.col("image_id") % 64, F.lit(64)), 9).alias("hann"), F.round(S.bits_per_pixel(F.col("file_size"), F.col("width"), F.col("height")), 6).alias("bpp"), S.grey(F.col("image_id") % 256, F.col("width") % 256, F.col("height") % 256).alias("grey"), S.tier_of_slider(F.col("image_id") % 101).alias("slider"))


def page_selector(spark, d):
    spec = F.concat((F.col("doc_id") % 3 + 1).cast("string"), F.lit(", "), (F.col("doc_id") % 5 + 2).cast("string"), F.lit("-"), (F.col("doc_id") % 5 + 4).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", S.pages_of(spec).cast("array<string>")).alias("pages"))


# ── kernels ──────────────────────────────────────────────────────────────────
def kernel_metrics(spark, d):
    """All metrics of the byte rasters by the production kernel."""
    return kernels.raster_metrics(text_images(spark, d)).select("image_id", *[_r(c) for c in kernels.RASTER_METRICS], "error")


def kernel_exact(spark, d):
    """Those kernel metrics that plain SQL can express."""
    k = kernels.raster_metrics(text_images(spark, d))
    return k.select("image_id", _r("brightnessAvg"), _r("brightnessStdevMax"), _r("foregroundRatio"), _r("backgroundP90"), _r("shadowEdgeCenterDiff"), _r("zoneBrightnessDiff"), _r("fftJpegBlockiness"))


def raster_check(spark, d):
    """Rasters to results: kernel, rules, score."""
    from .engine import QualityEngine

    return QualityEngine(mode="thorough", detect_bounds=True).check(text_images(spark, d)).select("image_id", "preset", F.concat_ws(",", F.col("issues.code")).alias("codes"), "score", "pass", "confidence", "status")


def raster_degrade(spark, d):
    """Damaged rasters and how the metrics move."""
    images = text_images(spark, d).withColumn("path", F.col("image_id").cast("string"))
    return kernels.raster_metrics(degrade.degrade(images, ["blur", "darken"]), "fast").select("image_id", _r("brightnessAvg"), _r("laplacianStdev"))


def damage_plan(spark, d):
    return degrade.plan_damages(table(spark, d, "features")).select("path", F.concat_ws("+", "damages").alias("damages"), "tier")


def vector_images(spark, d) -> DataFrame:
    """The vector rasters as one binary cell each (64 rows at most)."""

    @F.pandas_udf("binary")
    def stack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: b"".join(bytes(int(v) for v in x) for x in r))

    e = table(spark, d, "embeddings")
    shade = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.55) * 230))).cast("int"))
    by = e.select(F.expr("vec_id div 64").alias("image_id"), "vec_id", shade.alias("g")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "g"))).alias("r"))
    return by.select("image_id", F.lit(64).alias("width"), F.size("r").alias("height"), F.lit(1).alias("n_channels"), stack(F.col("r.g")).alias("data"))


def spectrum_metrics(spark, d):
    """High-frequency share, peaks and directional ratio by the kernel."""
    k = kernels.raster_metrics(vector_images(spark, d)).filter("fftHighFreqRatio is not null")
    return k.select("image_id", F.round("fftHighFreqRatio", 6).alias("high_freq"), F.col("fftSpectralPeaks").alias("peaks"), F.round("directionalEnergyRatio", 4).alias("directional"))


def component_stats(spark, d):
    """Connected dark parts of the vector rasters by the kernel: number, area, outline."""

    @F.pandas_udf("parts long, area long, outline long")
    def label(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.DataFrame:
        import numpy as np

        found = [kernels.components(np.frombuffer(r, dtype=np.uint8).reshape(h, w) < 128) for w, h, r in zip(width, height, data, strict=True)]
        return pd.DataFrame({"parts": [len(f["area"]) for f in found], "area": [int(f["area"].sum()) for f in found], "outline": [int(f["perimeter"].sum()) for f in found]})

    return vector_images(spark, d).select("image_id", label("width", "height", "data").alias("c")).select("image_id", "c.*").filter("parts > 0")


def boundary_detect(spark, d):
    """Page bounds in the byte rasters; null where there is no clear page."""
    return kernels.bounds(text_images(spark, d)).select("image_id", "boundary.detected", "boundary.region.x", "boundary.region.y", F.col("boundary.region.width").alias("w"), F.col("boundary.region.height").alias("h"))


# ── features and models ──────────────────────────────────────────────────────
def features_fast(spark, d):
    """Fast part of the vector: mean and presence of each feature."""
    return _feature_means(_features(spark, d).filter("mode = 'fast'"), FEATURES[:15])


def features_thorough(spark, d):
    return _feature_means(_features(spark, d).filter("mode = 'thorough'"), FEATURES)


def _feature_means(rows, names):
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < 1e12), F.col(c))
    return rows.groupBy("preset").agg(F.count(F.lit(1)).alias("n"), *[F.count(ok(c)).alias(f"n_{c}") for c in names], *[F.max(ok(c)).alias(f"max_{c}") for c in names])


def union_modes(spark, d):
    """Fast and thorough rows of the same files put together again, by name."""
    f = table(spark, d, "features")
    fast = f.filter("mode = 'fast'").select("image_id", "mode", *FEATURES[:15])
    slow = f.filter("mode = 'thorough'").select("image_id", "mode", *FEATURES)
    return fast.unionByName(slow, allowMissingColumns=True).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"), F.count("textCharShapeCV").alias("with_shape"))


TWO_TREES = {
    "trees": [
        [{"split": 8, "split_condition": 20.0, "missing": 1, "left": {"leaf": -0.2}, "right": {"split": 6, "split_condition": 120.0, "missing": 0, "left": {"leaf": -0.1}, "right": {"leaf": 0.2}}}],
        [{"split": 22, "split_condition": 5.0, "missing": 0, "left": {"leaf": 0.15}, "right": {"leaf": -0.15}}],
    ],
    "base_score": 0.5,
    "objective": "reg:squarederror",
}


def tree_score(spark, d):
    return table(spark, d, "features").select("row_id", F.round(models.scorer(TWO_TREES), 6).alias("score"))


def model_select(spark, d):
    """Thorough model where thorough features are present, else the fast one."""
    bundle = {"thorough": TWO_TREES, "fast": {"trees": [[{"split": 11, "split_condition": 0.1, "missing": 0, "left": {"leaf": -1.0}, "right": {"leaf": 1.0}}]], "base_score": 0.0, "objective": "binary:logistic"}}
    return table(spark, d, "features").select("row_id", F.round(models.select_scorer(bundle), 6).alias("score"))


def _model_sets(f) -> dict:
    """Rows and columns that each model learns from; the preflight model takes what fast rows have of its columns."""
    fast = f.filter("mode = 'fast'")
    return {"fast": (fast, FEATURES[:15]), "thorough": (f.filter("mode = 'thorough'"), FEATURES), "preflight": (fast, [c for c in PREFLIGHT_FEATURES if c in f.columns])}


def model_train(spark, d):
    """Boosted trees (100 of depth 4) of the three models on the rows that aren't held out, scored on those that are."""
    f = _features(spark, d).withColumn("split", F.lower(F.trim("split")))
    parts = []
    for name, (rows, names) in _model_sets(f).items():
        m = models.train(rows.filter("split = 'train'"), names, rounds=100, depth=4)
        scored = rows.filter("split <> 'train'").withColumn("score", models.scorer(m, names)).filter(F.col("label").between(0.0, 1.0))
        parts.append(rollup.regression_metrics(scored).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def _scored(spark, d):
    return table(spark, d, "features").filter(F.col("label").between(0.0, 1.0)).withColumn("score", models.scorer(TWO_TREES))


def regression_metrics(spark, d):
    return rollup.regression_metrics(_scored(spark, d).withColumn("preset", F.lower(F.trim("preset"))), by=["preset"]).select("preset", "n", _r("mae"), _r("rmse"), _r("r2"))


def confusion(spark, d):
    return rollup.confusion(_scored(spark, d)).select("tp", "tn", "fp", "fn", _r("accuracy"))


def tier_metrics(spark, d):
    return rollup.by_tier(_scored(spark, d)).select("tier", "n", _r("mae"), _r("accuracy"))


def top_worst(spark, d):
    return rollup.worst(_scored(spark, d), "row_id").select("row_id", "label", _r("score"), _r("error"))


def stratified_split(spark, d):
    return rollup.stratified_split(table(spark, d, "features"))


def semi_join_testset(spark, d):
    """Feature rows whose path is in the test side."""
    test = rollup.stratified_split(table(spark, d, "features")).filter("test").select("path")
    return table(spark, d, "features").join(test, "path", "left_semi").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def anti_join_trainset(spark, d):
    test = rollup.stratified_split(table(spark, d, "features")).filter("test").select("path")
    return table(spark, d, "features").join(test, "path", "left_anti").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def first_labels(spark, d):
    return rollup.first_labels(table(spark, d, "features"))


# ── preflight, pages, tiers, labels ──────────────────────────────────────────
def _preflight(spark, d):
    p = table(spark, d, "preflight")
    return rules.preflight(p.select("image_id", "received_at", *[c for c in PREFLIGHT_FEATURES if c in p.columns]))


def preflight_rules(spark, d):
    return _preflight(spark, d).groupBy(F.concat_ws(",", F.col("issues.code")).alias("codes"), "pass").agg(F.count(F.lit(1)).alias("n"))


def preflight_vs_backend(spark, d):
    """Images the quick check rejects and the full check passes."""
    full = _judged(spark, d).filter("mode = 'thorough'").select("image_id", "pass")
    return rollup.monotone_violations(_preflight(spark, d), full)


def pages_rollup(spark, d):
    """Recorded page results rolled up again by document."""
    r = table(spark, d, "results").filter("pageResults is not null").select("result_id", "preset", F.explode("pageResults").alias("p"))
    pages = r.select("result_id", "preset", "p.page", "p.pass", "p.score", F.array().cast(rules.ISSUE).alias("issues")).filter(F.col("score").between(0.0, 1.0))
    return rollup.pages(pages, "result_id").select("result_id", F.size("pageResults").alias("pages"), "pass", "score", "worstPageScore", "confidence")


def tier_summary(spark, d):
    cat, tier = rollup.path_parts(F.col("path"))
    r = table(spark, d, "results").withColumns({"category": cat, "tier": tier})
    return rollup.tier_summary(r, ["category", "tier"]).select("category", "tier", "n", "passed", "failed", "errors", _r("min_score"), _r("max_score"), _r("avg_score"))


def tier_rollup(spark, d):
    cat, tier = rollup.path_parts(F.col("path"))
    r = table(spark, d, "results").withColumns({"category": cat, "tier": tier}).filter("category is not null and tier is not null")
    return rollup.tier_summary(r, ["category", "tier"], cube=True).select("category", "tier", "n", "passed", "errors")


def label_counts(spark, d):
    return table(spark, d, "path_labels").groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


def label_upsert(spark, d):
    return rollup.latest_labels(table(spark, d, "path_labels")).select("path", "label", "score", "category")


def label_precedence_join(spark, d):
    """Every file with its label: recorded score, recorded tier, folder's tier."""
    _, tier = rollup.path_parts(F.col("path"))
    files = table(spark, d, "features").select("path").filter("path is not null").distinct()
    return rollup.labelled(files, table(spark, d, "path_labels"), tier).select("path", "label")


def ocr_confidence(spark, d):
    """Words of the texts with a made-up confidence each, as a reader would give."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", ((F.length("w") * 13 + F.col("doc_id")) % 101).alias("confidence"))
    return rollup.ocr_confidence(words).select("doc_id", "words", _r("median"), "low_words", "fires")


def first_unlabelled(spark, d):
    """The next file to label (a top-1 report)."""
    return rollup.first_unlabelled(label_precedence_join(spark, d), "path").select("path")


def seeded_shuffle(spark, d):
    """The first hundred of ``shuffle_places`` (a top-k report)."""
    paths = table(spark, d, "path_labels").select("path").filter("path is not null").distinct()
    first = rollup.shuffled(paths, "path", 7).limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.concat("path", F.lit("#7"))), "path")))


def shuffle_places(spark, d):
    """A seeded order of the labelled paths: every path with its place."""
    return rollup.shuffle_places(table(spark, d, "path_labels").select("path").filter("path is not null").distinct(), "path", 7)


def review_sort(spark, d):
    """The first fifty of ``review_places`` (a top-k report)."""
    return rollup.sorted_by(table(spark, d, "path_labels").select("path", "label_id"), "path", descending=True, then="label_id").limit(50)


def review_places(spark, d):
    """Label records by path without case, last first: every record with its place."""
    return rollup.sorted_places(table(spark, d, "path_labels").select("path", "label_id"), "path", "label_id", descending=True)


def model_folds(spark, d):
    """Cross-validated fit (5 folds) of the three models at full size: r2 per fold."""
    sets = _model_sets(_features(spark, d)).items()
    return reduce(DataFrame.unionByName, [models.cross_validate(rows, names, "path", folds=5, rounds=100, depth=4).withColumn("model", F.lit(name)) for name, (rows, names) in sets])


# ── streams ──────────────────────────────────────────────────────────────────
def uploads_windowed(spark, d):
    r = table(spark, d, "results").filter("error is null")
    return uploads.pass_rates(r, "analyzed_at", "pass", "preset")


def uploads_stream(spark, d):
    """The same roll-up run as a stream over the files of results (complete windows, all at once)."""
    r = spark.readStream.schema(spark.read.parquet(f"{d}/results.parquet").schema).parquet(f"{d}/results.parquet*").filter("error is null").select(F.col("analyzed_at").cast("timestamp").alias("analyzed_at"), "pass", "preset")
    return uploads.run_to_table(uploads.pass_rates(r, "analyzed_at", "pass", "preset"), spark)


def judged_stream(spark, d):
    """Rules on a stream of feature rows, as it is in batch."""
    f = spark.readStream.schema(spark.read.parquet(f"{d}/features.parquet").schema).parquet(f"{d}/features.parquet*")
    out = uploads.judged(f, mode=F.lower(F.trim("mode"))).select("row_id", "score", "pass")
    return uploads.run_to_table(out, spark)


# ── profile ──────────────────────────────────────────────────────────────────
def p5_found(spark, d):
    return prof.found(table(spark, d, "features"))


def p5_profile(spark, d):
    """The 42 features, with the ranges that the definitions give; ``p5_columns`` has every column."""
    return prof.profile(table(spark, d, "features"), prof.ALL_CHECKS)


def p5_columns(spark, d):
    """Every column of the feature table over all loads."""
    return prof.profile_all(table(spark, d, "features"))


def p5_loads(spark, d):
    """Every column of the feature table by load: null counts, distincts, ranges, medians."""
    return prof.loads_all(table(spark, d, "features"))


def p5_drift(spark, d):
    """Changes between loads of every column: numbers by steps of their range, texts by value."""
    f = table(spark, d, "features")
    checks, texts = prof.columns_of(f)
    return prof.drift(f, checks, texts=texts)


QUERIES = {
    f.__name__: f
    for f in (
        features_judged, meta_rules_fast, preset_detect, threshold_resolve, score_penalty_override, custom_rule, issue_counts, issues_exploded, guidance_lookup, score_product,
        confidence_band, scorer_fallback, channel_stats, text_contrast, histogram_p90, half_split, edge_center_shadow, quadrant_zones, laplacian_stats, jpeg_blockiness, skew_regression,
        row_clusters, baseline_deviation, largest_parts, boundary_scan, area_average, color_saturation, scalar_functions, page_selector, spectrum_metrics, component_stats, boundary_detect, first_unlabelled, seeded_shuffle, shuffle_places, review_sort, review_places, model_folds, kernel_metrics, kernel_exact, raster_check,
        raster_degrade, damage_plan, features_fast, features_thorough, union_modes, tree_score, model_select, model_train, regression_metrics, confusion, tier_metrics, top_worst,
        stratified_split, semi_join_testset, anti_join_trainset, first_labels, preflight_rules, preflight_vs_backend, pages_rollup, tier_summary, tier_rollup, label_counts, label_upsert,
        label_precedence_join, ocr_confidence, uploads_windowed, uploads_stream, judged_stream, p5_found, p5_profile, p5_columns, p5_loads, p5_drift,
    )
}

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
