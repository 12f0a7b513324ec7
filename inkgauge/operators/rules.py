"""Threshold rules over metric rows, scoring, and the quick check.

Metric columns carry the names of the feature vector. A rule whose metric is
null doesn't fire; NaN is null. Rules emit structs in a fixed order, so the
score's product of penalties has one order of factors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FEATURES, GUIDANCE, PREFLIGHT, PRESET_INDEX
from ..functions.scalar import bits_per_pixel, confidence, detect_preset, half_up, present, threshold

Limit = Callable[[str], Column]
ISSUE = "array<struct<analyzer:string,code:string,guidance:string,message:string,value:double,threshold:double,penalty:double,page:int>>"


@dataclass(frozen=True)
class Rule:
    code: str
    analyzer: str
    metric: str
    limit: str
    penalty: float
    above: bool  # fires above the limit, else below
    thorough: bool = False
    also: Callable[[Limit], Column] | None = None  # a further condition


def _m(name: str) -> Column:
    return F.col(name)


#: Codes, analyzers, thresholds and penalties, in order of emission.
RULES = [
    Rule("low-resolution", "resolution", "megapixels", "resolutionMin", 0.5, False),
    Rule("resolution-too-high", "resolution", "megapixels", "resolutionMax", 0.5, True),
    Rule("file-too-small", "fileSize", "fileSize", "fileSizeMin", 0.7, False),
    Rule("file-too-large", "fileSize", "fileSize", "fileSizeMax", 0.5, True),
    Rule("too-dark", "brightness", "brightnessAvg", "brightnessMin", 0.6, False),
    Rule("overexposed", "brightness", "brightnessAvg", "brightnessMax", 0.7, True, also=lambda t: _m("brightnessAvg") >= t("brightnessMin")),
    Rule("noisy", "sharpness", "laplacianMean", "sharpnessMax", 0.4, True),
    Rule("blurry", "sharpness", "laplacianStdev", "sharpnessMin", 0.5, False, also=lambda t: F.coalesce(_m("laplacianMean") <= t("sharpnessMax"), F.lit(True))),
    Rule("low-dpi", "dpi", "dpi", "dpiMin", 0.7, False, also=lambda t: _m("dpi") > 200),
    Rule("blank-page", "blankPage", "brightnessStdevMax", "blankVarianceMax", 0.1, False),
    Rule("heavy-compression", "compression", "bpp", "compressionBppMin", 0.7, False, also=lambda t: (_m("isJpeg") == 1) & (_m("megapixels") > 0)),
    Rule("low-edge-density", "edgeDensity", "edgeRatio", "edgeDensityMin", 0.6, False, True),
    Rule("high-edge-density", "edgeDensity", "edgeRatio", "edgeDensityMax", 0.4, True, True),
    Rule("low-contrast", "textContrast", "foregroundRatio", "contrastMin", 0.6, False, True),
    Rule("too-dark-content", "textContrast", "foregroundRatio", "contrastMax", 0.7, True, True),
    Rule("uneven-focus", "perspective", "sharpnessRatioTopBot", "uniformitySharpnessRatio", 0.65, True, True),
    Rule("uneven-lighting", "perspective", "brightnessDiffTopBot", "uniformityBrightnessDiff", 0.7, True, True),
    Rule("shadow-on-edges", "shadow", "shadowEdgeCenterDiff", "shadowBrightnessDiff", 0.7, True, True),
    Rule("dark-shadow", "shadow", "centerBrightness", "darkShadowCenterMax", 0.65, False, True, also=lambda t: _m("shadowEdgeCenterDiff") > t("darkShadowDiffMin")),
    Rule("dim-background", "dimBackground", "backgroundP90", "backgroundP90Min", 0.75, False, True),
    Rule("uneven-zone-brightness", "zoneQuality", "zoneBrightnessDiff", "zoneBrightnessMaxDiff", 0.7, True, True),
    Rule("uneven-zone-sharpness", "zoneQuality", "zoneSharpnessRatio", "zoneSharpnessMinRatio", 0.7, False, True, also=lambda t: ~F.coalesce(_m("zoneBrightnessDiff") > t("zoneBrightnessMaxDiff"), F.lit(False))),
    Rule("wavy-text-lines", "textGeometry", "textBaselineDeviation", "baselineDeviationMax", 0.6, True, True),
    Rule("inconsistent-char-size", "textGeometry", "textCharSizeCV", "charSizeCVMax", 0.7, True, True),
    Rule("distorted-char-shapes", "textGeometry", "textCharShapeCV", "charShapeCVMax", 0.65, True, True),
    Rule("tilted", "skew", "skewAngle", "skewAngleMax", 0.85, True, True),
    Rule("grayscale-in-color", "colorDepth", "colorSaturation", "colorSaturationMin", 0.97, False, True, also=lambda t: (_m("channelCount") >= 3) & ~_m("_grey_space")),
    Rule("fft-blur", "fftBlur", "fftHighFreqRatio", "fftBlurHighFreqMin", 0.6, False, True),
    Rule("fft-noise", "fftNoise", "fftHighFreqRatio", "fftNoiseHighFreqMax", 0.7, True, True),
    Rule("fft-moire", "fftMoire", "fftSpectralPeaks", "fftMoirePeaksMax", 0.7, True, True),
    Rule("jpeg-artifacts", "fftJpegArtifact", "fftJpegBlockiness", "fftJpegGridMax", 0.8, True, True, also=lambda t: _m("isJpeg") == 1),
    Rule("directional-blur", "directionalBlur", "directionalEnergyRatio", "directionalBlurRatioMax", 0.65, True, True),
]
OCR_METRICS = ["ocrMedianConfidence", "ocrWords"]
OCR_RULE = Rule("low-ocr-confidence", "ocrConfidence", "ocrMedianConfidence", "ocrConfidenceMin", 0.6, False, also=lambda t: _m("ocrWords") >= 5)


def _fires(rule: Rule, limit: Limit, mode: Column) -> Column:
    value, t = _m(rule.metric), limit(rule.limit)
    fires = (value > t) if rule.above else (value < t)
    if rule.thorough:
        fires = (mode == "thorough") & fires
    if rule.also:
        fires = fires & rule.also(limit)
    return F.coalesce(fires, F.lit(False))


def _issue(rule: Rule, fires: Column, limit: Limit, penalties: dict[str, float]) -> Column:
    value, t = _m(rule.metric), limit(rule.limit)
    text = F.concat(F.lit(f"{rule.metric} is "), F.round(value, 3).cast("string"), F.lit(" with a limit of "), t.cast("string"))
    body = F.struct(
        F.lit(rule.analyzer).alias("analyzer"), F.lit(rule.code).alias("code"), F.lit(GUIDANCE[rule.code]).alias("guidance"), text.alias("message"),
        value.cast("double").alias("value"), t.alias("threshold"), F.lit(float(penalties.get(rule.analyzer, rule.penalty))).alias("penalty"), F.lit(None).cast("int").alias("page"),
    )
    return F.when(fires, body)


def custom_issue(fires: Column, analyzer: str, value: Column, limit: Column, penalty: float, code: str = "custom") -> Column:
    """Issue of a user rule; unknown codes get the general advice."""
    return F.when(fires, F.struct(
        F.lit(analyzer).alias("analyzer"), F.lit(code).alias("code"), F.lit(GUIDANCE.get(code, GUIDANCE["custom"])).alias("guidance"), F.lit(analyzer).alias("message"),
        value.cast("double").alias("value"), limit.cast("double").alias("threshold"), F.lit(float(penalty)).alias("penalty"), F.lit(None).cast("int").alias("page"),
    ))


def product(found: Column) -> Column:
    """Ordered product of the issues' penalties."""
    return F.aggregate(found, F.lit(1.0), lambda a, i: a * i["penalty"])


def final_score(default: Column, scorer: Column | None = None) -> Column:
    """The scorer's value clamped to 0..1; where it is null, NaN or infinite, the default. Rounded half up."""
    if scorer is not None:
        usable = scorer.isNotNull() & ~F.isnan(scorer) & (F.abs(scorer) < F.lit(float("inf")))
        default = F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), scorer))).otherwise(default)
    return half_up(default)


def rules_of(ocr: bool = False) -> list[Rule]:
    return RULES + ([OCR_RULE] if ocr else [])


def judge(metrics: DataFrame, preset: str | Column = "auto", mode: str | Column = "fast", overrides: dict | None = None, penalties: dict | None = None, scorer: Column | None = None, ocr: bool = False, extra: list[Column] = ()) -> DataFrame:
    """Metric rows with preset, presetIdx, fired, issues, codes, n_issues, score, pass and confidence added.

    ``preset`` 'auto' takes the row's own ``preset`` (trimmed, lower case) where
    it names one, else the shape of the image decides. ``extra`` are issue
    structs of user rules (null where quiet). No shuffle. Null metrics fire no
    rule, so an empty row passes with score 1. Conditions are evaluated once,
    into the bits of ``fired``; score, codes and numbers are read off the bits
    in generated code, and the structs of ``issues`` are only built where they are selected.
    A column ``space`` of 'b-w' or 'grey' keeps the colour rule quiet.
    """
    names = [*FEATURES, *(OCR_METRICS if ocr else [])]
    metrics = metrics.withColumns({c: present(F.col(c).cast("double")) for c in names if c in metrics.columns} | {c: F.lit(None).cast("double") for c in names if c not in metrics.columns})
    if isinstance(preset, str) and preset == "auto":
        own = F.lower(F.trim(F.col("preset"))) if "preset" in metrics.columns else F.lit(None).cast("string")
        preset = F.when(own.isin("document", "receipt", "card"), own).otherwise(detect_preset(F.col("width"), F.col("height")))
    preset = F.lit(preset) if isinstance(preset, str) else preset
    mode = F.lit(mode) if isinstance(mode, str) else mode
    space = F.coalesce(F.lower("space").isin("b-w", "grey"), F.lit(False)) if "space" in metrics.columns else F.lit(False)
    rules, penalties = rules_of(ocr), penalties or {}
    limit: Limit = lambda name: threshold(name, F.col("preset"), overrides)
    rows = metrics.withColumns({"preset": preset, "_mode": mode, "_grey_space": space})
    index = F.coalesce("presetIdx", *[F.when(F.col("preset") == p, F.lit(float(i))) for p, i in PRESET_INDEX.items()])
    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        mask = mask + F.when(_fires(r, limit, F.col("_mode")), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"presetIdx": index, "fired": mask, "_extra": F.array_compact(F.array(*extra)).cast(ISSUE) if extra else F.array().cast(ISSUE)})
    bit = lambda i: F.col("fired").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    found = F.array_compact(F.array(*[_issue(r, bit(i), limit, penalties) for i, r in enumerate(rules)])).cast(ISSUE)
    factors = F.lit(1.0)
    for i, r in enumerate(rules):
        factors = factors * F.when(bit(i), F.lit(float(penalties.get(r.analyzer, r.penalty)))).otherwise(F.lit(1.0))
    codes = F.concat_ws(",", *[F.when(bit(i), F.lit(r.code)) for i, r in enumerate(rules)], *([F.col("_extra.code")] if extra else []))
    count = F.bit_count("fired")
    if extra:
        found, count = F.concat(found, F.col("_extra")), count + F.size("_extra")
        factors = F.aggregate("_extra", factors, lambda a, i: a * i["penalty"])
    judged = rows.withColumns({"issues": found, "codes": codes, "n_issues": count, "score": final_score(factors, scorer)})
    top = threshold("passThreshold", F.col("preset"), overrides)
    return judged.withColumns({"pass": F.col("score") >= top, "confidence": confidence(F.col("score"), top)}).drop("_mode", "_grey_space", "_extra")


def issue_totals(judged: DataFrame, *by: str, ocr: bool = False) -> DataFrame:
    """(by, analyzer, code, n) of the fixed rules from the bits of ``fired``: rows are
    never multiplied, one partial sum per rule and group is."""
    rules = rules_of(ocr)
    sums = judged.groupBy(*by).agg(*[F.sum(F.shiftright("fired", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"_{i}") for i in range(len(rules))])
    lines = F.array(*[F.struct(F.lit(r.analyzer).alias("analyzer"), F.lit(r.code).alias("code"), F.col(f"_{i}").alias("n")) for i, r in enumerate(rules)])
    return sums.select(*by, F.explode(lines).alias("l")).select(*by, "l.*").filter("n > 0")


def exploded(judged: DataFrame, *keys: str) -> DataFrame:
    """One row per issue."""
    return judged.select(*keys, F.posexplode("issues").alias("no", "i")).select(*keys, "no", "i.*")


# name, metric, limit, fires above; the pixel rules are skipped for images of too few pixels
_QUICK = [
    ("file-too-small", "fileSize", "fileSizeMin", False, False),
    ("file-too-large", "fileSize", "fileSizeMax", True, False),
    ("low-resolution", "megapixels", "resolutionMin", False, False),
    ("resolution-too-high", "megapixels", "resolutionMax", True, False),
    ("too-dark", "brightnessAvg", "brightnessMin", False, True),
    ("overexposed", "brightnessAvg", "brightnessMax", True, True),
    ("blank-page", "blankStdevMax", "blankStdevMax", False, True),
    ("blurry", "laplacianStdev", "sharpnessMin", False, True),
    ("low-edge-density", "edgeRatio", "edgeDensityMin", False, True),
    ("low-contrast", "foregroundRatio", "contrastFgMin", False, True),
]


def preflight(metrics: DataFrame, overrides: dict | None = None, scorer: Column | None = None) -> DataFrame:
    """Quick check of thumbnail metrics: codes, issues and pass (no issue, or score >= 0.5 with a scorer)."""
    t = PREFLIGHT | (overrides or {})
    metrics = metrics.withColumns({m: present(F.col(m).cast("double")) for m in {q[1] for q in _QUICK}})
    seen = F.col("megapixels") >= t["resolutionMin"]

    def fires(metric: str, limit: str, above: bool, pixels: bool) -> Column:
        c = F.col(metric) > t[limit] if above else F.col(metric) < t[limit]
        return c & seen if pixels else c

    made = [F.when(fires(m, lim, above, px), F.struct(F.lit(code).alias("code"), F.concat(F.lit(f"{m} is "), F.col(m).cast("string")).alias("message"), F.lit(GUIDANCE[code]).alias("guidance"))) for code, m, lim, above, px in _QUICK]
    out = metrics.withColumn("issues", F.array_compact(F.array(*made)))
    clean = F.size("issues") == 0
    if scorer is None:
        return out.withColumn("pass", clean)
    usable = scorer.isNotNull() & ~F.isnan(scorer) & (F.abs(scorer) < F.lit(float("inf")))
    score = F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), scorer)))
    return out.withColumn("score", score).withColumn("pass", F.coalesce(score >= 0.5, clean))


def metadata_metrics(meta: DataFrame) -> DataFrame:
    """Metrics that need no pixels, from width, height, file_size, format and density."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return meta.withColumns({"megapixels": w * h / 1e6, "aspectRatio": w / F.when(h == 0, F.lit(1.0)).otherwise(h), "fileSize": F.col("file_size").cast("double"), "bpp": bits_per_pixel(F.col("file_size").cast("double"), w, h), "dpi": F.col("density").cast("double"), "isJpeg": (F.col("format") == "jpeg").cast("double")})


