"""SQL that DuckDB runs on the same tables, written apart from the operators."""

from __future__ import annotations

from ..functions.constants import FEATURES, GUIDANCE, PRESETS, THRESHOLDS
from ..operators.profile import ALL_CHECKS, INF

# ── rules on feature rows ────────────────────────────────────────────────────
_T = ", ".join(f"({', '.join([repr(p)] + [str(PRESETS[p].get(n, v)) + '::double' for n, v in THRESHOLDS.items()])})" for p in PRESETS)
_T = f"t(p, {', '.join(THRESHOLDS)}) as (values {_T})"
_SHAPE = """case when width / nullif_zero < 0.4 or width / nullif_zero > 2.5 then 'receipt'
  when ((width / nullif_zero between 1.3 and 1.9) or (width / nullif_zero between 0.53 and 0.77)) and width * height / 1e6 < 2.0 then 'card' else 'document' end""".replace("nullif_zero", "(case when height = 0 then 1 else height end)")
_OWN = "case when lower(trim(preset)) in ('document', 'receipt', 'card') then lower(trim(preset)) end"
_CLEAN = ", ".join(f'case when isnan("{c}") then null else "{c}" end as "{c}"' for c in FEATURES)

# code, analyzer, penalty, condition; in order of emission
_RULES = [
    ("low-resolution", "resolution", 0.5, "megapixels < resolutionMin"),
    ("resolution-too-high", "resolution", 0.5, "megapixels > resolutionMax"),
    ("file-too-small", "fileSize", 0.7, "fileSize < fileSizeMin"),
    ("file-too-large", "fileSize", 0.5, "fileSize > fileSizeMax"),
    ("too-dark", "brightness", 0.6, "brightnessAvg < brightnessMin"),
    ("overexposed", "brightness", 0.7, "brightnessAvg > brightnessMax and not brightnessAvg < brightnessMin"),
    ("noisy", "sharpness", 0.4, "laplacianMean > sharpnessMax"),
    ("blurry", "sharpness", 0.5, "laplacianStdev < sharpnessMin and not coalesce(laplacianMean > sharpnessMax, false)"),
    ("low-dpi", "dpi", 0.7, "dpi > 200 and dpi < dpiMin"),
    ("blank-page", "blankPage", 0.1, "brightnessStdevMax < blankVarianceMax"),
    ("heavy-compression", "compression", 0.7, "isJpeg = 1 and megapixels > 0 and bpp < compressionBppMin"),
    ("low-edge-density", "edgeDensity", 0.6, "slow and edgeRatio < edgeDensityMin"),
    ("high-edge-density", "edgeDensity", 0.4, "slow and edgeRatio > edgeDensityMax"),
    ("low-contrast", "textContrast", 0.6, "slow and foregroundRatio < contrastMin"),
    ("too-dark-content", "textContrast", 0.7, "slow and foregroundRatio > contrastMax"),
    ("uneven-focus", "perspective", 0.65, "slow and sharpnessRatioTopBot > uniformitySharpnessRatio"),
    ("uneven-lighting", "perspective", 0.7, "slow and brightnessDiffTopBot > uniformityBrightnessDiff"),
    ("shadow-on-edges", "shadow", 0.7, "slow and shadowEdgeCenterDiff > shadowBrightnessDiff"),
    ("dark-shadow", "shadow", 0.65, "slow and centerBrightness < darkShadowCenterMax and shadowEdgeCenterDiff > darkShadowDiffMin"),
    ("dim-background", "dimBackground", 0.75, "slow and backgroundP90 < backgroundP90Min"),
    ("uneven-zone-brightness", "zoneQuality", 0.7, "slow and zoneBrightnessDiff > zoneBrightnessMaxDiff"),
    ("uneven-zone-sharpness", "zoneQuality", 0.7, "slow and zoneSharpnessRatio < zoneSharpnessMinRatio and not coalesce(zoneBrightnessDiff > zoneBrightnessMaxDiff, false)"),
    ("wavy-text-lines", "textGeometry", 0.6, "slow and textBaselineDeviation > baselineDeviationMax"),
    ("inconsistent-char-size", "textGeometry", 0.7, "slow and textCharSizeCV > charSizeCVMax"),
    ("distorted-char-shapes", "textGeometry", 0.65, "slow and textCharShapeCV > charShapeCVMax"),
    ("tilted", "skew", 0.85, "slow and skewAngle > skewAngleMax"),
    ("grayscale-in-color", "colorDepth", 0.97, "slow and channelCount >= 3 and colorSaturation < colorSaturationMin"),
    ("fft-blur", "fftBlur", 0.6, "slow and fftHighFreqRatio < fftBlurHighFreqMin"),
    ("fft-noise", "fftNoise", 0.7, "slow and fftHighFreqRatio > fftNoiseHighFreqMax"),
    ("fft-moire", "fftMoire", 0.7, "slow and fftSpectralPeaks > fftMoirePeaksMax"),
    ("jpeg-artifacts", "fftJpegArtifact", 0.8, "slow and isJpeg = 1 and fftJpegBlockiness > fftJpegGridMax"),
    ("directional-blur", "directionalBlur", 0.65, "slow and directionalEnergyRatio > directionalBlurRatioMax"),
]


def _judge(rows: str, changed: dict | None = None, penalties: dict | None = None, more: str = "", tail: str = "") -> str:
    """WITH clause that defines judged(…, preset, codes, score, pass, confidence) over ``rows``."""
    conds, product = [], "1.0::double"
    for code, analyzer, pen, cond in _RULES:
        for k, v in (changed or {}).items():
            cond = cond.replace(k, f"{v}::double")
        conds.append(f"case when {cond} then '{code}' end")
        product += f" * case when {cond} then {(penalties or {}).get(analyzer, pen)}::double else 1.0::double end"
    limit = f"{changed['passThreshold']}::double" if changed and "passThreshold" in changed else "passThreshold"
    return f"""{_T}, rows_in as ({rows}), raw as (select r.*, t.*, concat_ws(',', {', '.join(conds)}) as codes, {product}{more} as prod from rows_in r join t on r.preset = t.p),
      judged as (select *, floor(prod * 100 + 0.5) / 100 as score, floor(prod * 100 + 0.5) / 100 >= {limit} as pass,
        case when abs(floor(prod * 100 + 0.5) / 100 - {limit}) >= 0.2 then 'high' when abs(floor(prod * 100 + 0.5) / 100 - {limit}) >= 0.1 then 'medium' else 'low' end as confidence from raw){tail}"""


_FEATURE_ROWS = f"select row_id, image_id, lower(trim(mode)) as mode, coalesce(lower(trim(mode)) = 'thorough', false) as slow, coalesce({_OWN}, {_SHAPE}) as preset, {_CLEAN} from features"
_META = """meta as (select doc_id as image_id, (300 + doc_id * 37 % 2900)::int as width, (300 + doc_id * 53 % 3700)::int as height, coalesce(n_chars, 0) * 50 as file_size,
  case lower(trim(coalesce(lang, 'und'))) when 'en' then 'jpeg' when 'de' then 'png' when 'fr' then 'tiff' else 'webp' end as format, (72 + 37 * (doc_id % 8))::double as density from documents)"""
_NULLS = ", ".join(f"null::double as \"{c}\"" for c in FEATURES if c not in ("megapixels", "fileSize", "bpp", "dpi", "isJpeg"))
_META_ROWS = f"select image_id, false as slow, {_SHAPE} as preset, width::double * height / 1e6 as megapixels, file_size::double as fileSize, file_size * 8.0::double / (width::double * height) as bpp, density as dpi, (format = 'jpeg')::int::double as isJpeg, {_NULLS} from meta"

# ── pixels ───────────────────────────────────────────────────────────────────
_TEXT_PX = """hx as (select doc_id as image_id, regexp_extract_all(hex(encode(text)), '..') as b from documents where text is not null),
px0 as (select image_id, unnest(b) as h, generate_subscripts(b, 1) - 1 as pos, len(b) as n from hx),
px as materialized (select image_id, (pos % 128)::int as x, (pos // 128)::int as y, (case when ('0x' || h)::int <= 32 then 240 else 2 * (('0x' || h)::int % 64) end)::int as g from px0 where pos < n // 128 * 128)"""
_VEC_PX = """px as materialized (select vec_id // 64 as image_id, (generate_subscripts(embedding, 1) - 1)::int as x, (vec_id % 64)::int as y, least(255, greatest(0, floor((unnest(embedding)::double + 0.55) * 230)))::int as g from embeddings)"""
_SIZED = "sized as (select *, max(x) over (partition by image_id) + 1 as w, max(y) over (partition by image_id) + 1 as h from px)"
_LAP = """three as (select *, g + lag(g) over (partition by image_id, y order by x) + lead(g) over (partition by image_id, y order by x) as s from px),
nine as (select *, s + lag(s) over (partition by image_id, x order by y) + lead(s) over (partition by image_id, x order by y) as k from three),
lap as (select image_id, x, y, greatest(0, least(255, 9 * g - k)) as v from nine where k is not null)"""
_RUNS = """dark as (select *, x - row_number() over (partition by image_id, y order by x) as i from px where g < 128),
runs as (select image_id, y, min(x) as x0, max(x) as x1, count(*) as area, (min(x) + max(x)) / 2 as cx, y::double as cy, y * 100000 + min(x) as label from dark group by image_id, y, i)"""
_ROWS = f"""{_VEC_PX}, {_RUNS}, stepped as (select *, case when cy - lag(cy) over (partition by image_id order by cy, label) > 1 then 1 else 0 end as jump from runs where area >= 3),
lines as (select *, sum(jump) over (partition by image_id order by cy, label rows unbounded preceding)::bigint as row_no from stepped)"""

# A direct transform, row by row and then column by column, of the mean-free windowed raster padded to a power of two.
_POWER = """v0 as (select vec_id // 64 as image_id, row_number() over (partition by vec_id // 64 order by vec_id) - 1 as y, embedding from embeddings),
p0 as (select image_id, y, generate_subscripts(embedding, 1) - 1 as x, least(255, greatest(0, floor((unnest(embedding)::double + 0.55) * 230)))::int as g from v0),
p1 as (select *, avg(g) over (partition by image_id) as mean, max(y) over (partition by image_id) + 1 as h from p0),
p2 as (select image_id, x, y, h, (2 ** ceil(log2(h)))::int as h2, (g - mean) * 0.5 * (1 - cos(2 * pi() * x / 63)) * 0.5 * (1 - cos(2 * pi() * y / (h - 1))) as v from p1 where h >= 32),
f1 as (select image_id, y, h2, k, sum(v * cos(2 * pi() * k * x / 64)) as re, -sum(v * sin(2 * pi() * k * x / 64)) as im from p2, range(0, 64) r(k) group by all),
f2 as (select image_id, h2, k, q, sum(re * cos(2 * pi() * q * y / h2) + im * sin(2 * pi() * q * y / h2)) as re, sum(im * cos(2 * pi() * q * y / h2) - re * sin(2 * pi() * q * y / h2)) as im from (select *, unnest(range(0, h2)) as q from f1) group by all),
power as (select image_id, re * re + im * im as p, least(k, 64 - k) / 32 as fx, least(q, h2 - q) / (h2 / 2) as fy from f2),
bins as materialized (select *, sqrt(fx * fx + fy * fy) as r, sum(p) over (partition by image_id) as e, count(*) over (partition by image_id) as n from power)"""
_PLAIN = "lower(regexp_replace(path, '[\\\\/]+(\\./)?', '/', 'g'))"
_PART = lambda i: f"nullif(regexp_extract({_PLAIN}, '(^|/)(documents|receipts|cards|photos)/(very-good|good|very-bad|bad|unsorted)/', {i + 1}), '')"
_SPLIT = """one as (select path, min(label) as label from features where path is not null and label is not null and not isnan(label) group by path),
tiered as (select path, case when label > 0 and label <= 0.25 then 'very-bad' when label > 0.25 and label <= 0.5 then 'bad' when label > 0.5 and label <= 0.75 then 'good' when label > 0.75 and label <= 1 then 'very-good' end as tier,
  ('0x' || substr(md5(path || '#42'), 1, 8))::bigint % 10000 < 1500 as test from one)"""
_SCORED = """scored as (select row_id, label, lower(trim(preset)) as preset, least(1.0, greatest(0.0, 0.5::double
  + case when laplacianStdev is null or isnan(laplacianStdev) or laplacianStdev > 20 then case when brightnessAvg is null or isnan(brightnessAvg) or brightnessAvg <= 120 then -0.1 else 0.2 end else -0.2 end::double
  + case when skewAngle is null or isnan(skewAngle) or skewAngle <= 5 then 0.15 else -0.15 end::double)) as score from features)"""
_GOOD = "scored where label >= 0 and label <= 1"
_BANDS = "case when abs(s - l) >= 0.2 then 'high' when abs(s - l) >= 0.1 then 'medium' else 'low' end"
_LIMIT = "case when preset in ('receipt', 'card') then 0.6 else 0.5 end"
_OKV = lambda c: f'case when not isnan("{c}") and abs("{c}") < 1e12 then "{c}" end'
_MEANS = lambda mode, names: "select preset, count(*) as n, " + ", ".join(f'count({_OKV(c)}) as "n_{c}", max({_OKV(c)}) as "max_{c}"' for c in names) + f" from features where lower(trim(mode)) = '{mode}' group by preset"
_LATEST = "latest as (select path, label, score, category from (select *, row_number() over (partition by path order by labeled_at desc nulls last, label_id desc) as no from path_labels where path is not null) where no = 1)"
_QUICK = [
    ("file-too-small", "fileSize < 13500"), ("file-too-large", "fileSize > 1.1e8"), ("low-resolution", "megapixels < 0.28"), ("resolution-too-high", "megapixels > 220"),
    ("too-dark", "seen and brightnessAvg < 45"), ("overexposed", "seen and brightnessAvg > 247"), ("blank-page", "seen and blankStdevMax < 1.7"), ("blurry", "seen and laplacianStdev < 5"),
    ("low-edge-density", "seen and edgeRatio < 0.005"), ("low-contrast", "seen and foregroundRatio < 0.008"),
]
_PRE = "quick as (select *, concat_ws(',', " + ", ".join(f"case when {c} then '{k}' end" for k, c in _QUICK) + ") as codes from (select image_id, " + ", ".join(f'case when isnan("{c}") then null else "{c}" end as "{c}"' for c in ("megapixels", "fileSize", "brightnessAvg", "laplacianStdev", "edgeRatio", "foregroundRatio", "blankStdevMax")) + ", megapixels >= 0.28 as seen from preflight))"

_CELLS = " union all ".join(
    f"select '{c}' as column_name, load_id, row_id, lower(trim(coalesce(mode, ''))) as mode, \"{c}\"::double as value, {'null' if k.low == -INF else k.low}::double as low, {'null' if k.high == INF else k.high}::double as high, {str(k.thorough).lower()} as thorough from features"
    for c, k in ALL_CHECKS.items()
)
_CELL_VIEW = f"cells as materialized (select *, value is not null and isfinite(value) and value >= coalesce(low, value) and value <= coalesce(high, value) as good, not thorough or mode = 'thorough' as due from ({_CELLS}))"
_OTHERS = " union all ".join(
    f"select '{c}' as column_name, load_id, row_id, lower(trim(coalesce(mode, ''))) as mode, {v}::double as value, {a} as low, {z} as high, false as thorough from features"
    for c, v, a, z in [("row_id", "row_id", "null", "null"), ("image_id", "image_id", "null", "null"), ("label", "label", "0", "1"), ("load_id", "load_id", "null", "null"), ("loaded_at", "epoch_us(loaded_at) / 1e6", "null", "null")]
)
_EVERY = _CELL_VIEW.replace(_CELLS, f"{_CELLS} union all {_OTHERS}")
_TEXTS = "texts as (" + " union all ".join(f"select '{c}' as column_name, load_id, {c} as value from features" for c in ("path", "preset", "mode", "source", "split")) + ")"
_TEXT_LINE = "count(*) as due, count_if(value is null)::bigint as nulls, count(value) as in_range, {} null::double as low, null::double as high, min(value) as low_text, max(value) as high_text"
_WINDOWED = "select time_bucket(interval 1 hour, analyzed_at) as start, preset, count(*) as n, count_if(pass)::bigint as passed from results where error is null and analyzed_at is not null group by all"

SQL = {
    "features_judged": f"with {_judge(_FEATURE_ROWS)} select row_id, preset, (case when codes = '' then 0 else len(string_split(codes, ',')) end)::int as n_issues, codes, score, pass, confidence from judged",
    "meta_rules_fast": f"with {_META}, {_judge(_META_ROWS)} select image_id, preset, codes, score, pass, confidence from judged",
    "preset_detect": f"with {_META} select image_id, {_SHAPE} as preset from meta",
    "threshold_resolve": f"with {_META}, {_T}, m as (select {_SHAPE} as preset from meta), n as (unpivot (select p, brightnessMin, passThreshold, fileSizeMin from t) on brightnessMin, passThreshold, fileSizeMin into name name value value) select m.preset, n.name, max(value) as value, count(*) as images from m join n on m.preset = n.p group by all",
    "score_penalty_override": f"with {_judge(_FEATURE_ROWS, {'sharpnessMin': 10, 'passThreshold': 0.7}, {'brightness': 0.9, 'shadow': 0.5})} select preset, mode, pass, count(*) as n, round(sum(score), 2) as score_sum from judged group by all",
    "custom_rule": f"with {_judge(_FEATURE_ROWS, more=' * case when aspectRatio > 1.5 then 0.8::double else 1.0::double end')} select preset, count_if(aspectRatio > 1.5)::bigint as custom, round(sum(score), 2) as score_sum from judged group by all",
    "issue_counts": f"with {_judge(_FEATURE_ROWS)}, e as (select preset, unnest(string_split(codes, ',')) as code from judged where codes <> ''), a(code, analyzer) as (values {', '.join(f'({c!r}, {a!r})' for c, a, _, _ in _RULES)}) select preset, analyzer, code, count(*) as n from e join a using (code) group by all",
    "issues_exploded": "with e as (select result_id, unnest(issues) as i, generate_subscripts(issues, 1) - 1 as no from results) select result_id, no::int as no, i.analyzer as analyzer, i.code as code, i.value as value, i.threshold as threshold, i.penalty as penalty, i.page as page from e",
    "guidance_lookup": f"with e as (select unnest(issues) as i from results), g(code) as (values {', '.join(f'({c!r})' for c in GUIDANCE)}) select i.code as code, count(*) as n, i.code in (select code from g) as known from e group by all",
    "score_product": f"with p as (select result_id, preset, floor(list_reduce(list_prepend(1.0::double, list_transform(issues, lambda i: i.penalty)), lambda a, b: a * b) * 100 + 0.5) / 100 as s, {_LIMIT} as l from results where error is null and issues is not null) select result_id, s as product, {_BANDS} as confidence from p",
    "confidence_band": f"with p as (select preset, score as s, {_LIMIT} as l from results where score >= 0 and score <= 1 and not isnan(score)) select preset, {_BANDS} as band, count(*) as n from p group by all",
    "scorer_fallback": f"with {_judge(_FEATURE_ROWS)}, s as (select row_id, case row_id % 5 when 2 then 1.0 when 3 then 0.0 when 4 then 0.46 else score end as score, passThreshold from judged) select row_id, score::double as score, score >= passThreshold as pass from s",
    "channel_stats": f"with {_TEXT_PX} select image_id, count(*) as n, round(sum(g) / count(*), 6) as mean, round(stddev_samp(g), 6) as stdev from px group by image_id",
    "text_contrast": f"with {_TEXT_PX} select image_id, round(count_if(g < 128) / count(*), 6) as foreground from px group by image_id",
    "histogram_p90": f"with {_TEXT_PX}, h as (select image_id, g, count(*) as c from px group by all), u as (select image_id, g, sum(c) over (partition by image_id order by g) as upto, sum(c) over (partition by image_id) as n from h) select image_id, min(g) as p90 from u where upto >= floor(n * 0.9) group by image_id",
    "half_split": f"with {_TEXT_PX}, {_SIZED}, m as (select image_id, avg(g) filter (y < h // 2) as top, avg(g) filter (y >= h // 2) as bottom, avg(g * g) filter (y < h // 2) - avg(g) filter (y < h // 2) ** 2 as vt, avg(g * g) filter (y >= h // 2) - avg(g) filter (y >= h // 2) ** 2 as vb from sized where h > 20 group by image_id) select image_id, round(top, 6) as top, round(bottom, 6) as bottom, round(abs(top - bottom), 6) as diff, round(case when least(vt, vb) > 5 then greatest(vt, vb) / least(vt, vb) end, 4) as ratio from m",
    "edge_center_shadow": f"with {_TEXT_PX}, {_SIZED}, s as (select *, greatest(1, floor(least(w, h) * 0.1))::int as e from sized where w >= 20 and h >= 20), m as (select image_id, avg(g) filter (y < e or y >= h - e or x < e or x >= w - e) as edge, avg(g) filter (x >= floor(w * 0.3) and x < floor(w * 0.7) and y >= floor(h * 0.3) and y < floor(h * 0.7)) as centre from s group by image_id) select image_id, round(edge, 6) as edge, round(centre, 6) as centre, round(centre - edge, 6) as diff from m where centre is not null",
    "quadrant_zones": f"with {_TEXT_PX}, {_SIZED}, m as (select image_id, avg(g) filter (y < h // 2 and x < w // 2) as z0, avg(g) filter (y < h // 2 and x >= w // 2) as z1, avg(g) filter (y >= h // 2 and x < w // 2) as z2, avg(g) filter (y >= h // 2 and x >= w // 2) as z3 from sized where h >= 100 and w >= 100 group by image_id) select image_id, round(z0, 6) as z0, round(z1, 6) as z1, round(z2, 6) as z2, round(z3, 6) as z3, round(greatest(z0, z1, z2, z3) - least(z0, z1, z2, z3), 6) as spread from m",
    "laplacian_stats": f"with {_TEXT_PX}, {_LAP} select image_id, round(sum(v) / count(*), 6) as mean, round(sqrt(greatest(0, sum(v * v) / count(*) - (sum(v) / count(*)) ** 2)), 6) as stdev, round(count_if(v > 30) / count(*), 6) as edge_ratio from lap group by image_id",
    "jpeg_blockiness": f"with {_TEXT_PX}, {_SIZED}, s as (select image_id, x % 8 = 0 as ox, y % 8 = 0 as oy, abs(g - lag(g) over (partition by image_id, y order by x)) as dx, abs(g - lag(g) over (partition by image_id, x order by y)) as dy from sized where w >= 16 and h >= 16), d as (select image_id, ox as grid, dx as step from s where dx is not null union all select image_id, oy, dy from s where dy is not null), m as (select image_id, avg(step) filter (grid) as a, avg(step) filter (not grid) as b from d group by image_id) select image_id, round(case when b < 0.1 then case when a > 0.5 then 10.0 else 0.0 end else greatest(0, a / b - 1) end, 6) as blockiness from m",
    "skew_regression": f"with {_VEC_PX}, {_LAP}, b as (select *, (max(x) over (partition by image_id) + 1) // 20 as sw, max(x) over (partition by image_id) + 1 as w, max(y) over (partition by image_id) + 1 as h from lap), s as (select image_id, x // sw as strip, any_value(sw) as sw, sum(y * v) / sum(v) as cy from b where w >= 20 and h >= 20 and v > 30 and x // sw < 20 group by image_id, x // sw) select image_id, round(degrees(abs(atan(regr_slope(cy, strip * sw + sw / 2)))), 6) as angle from s group by image_id having count(*) >= 3",
    "row_clusters": f"with {_ROWS} select image_id, row_no, count(*) as n, min(y) as first_y, max(y) as last_y from lines group by all",
    "baseline_deviation": f"with {_ROWS}, r as (select image_id, row_no, count(*) as n, regr_sxx(cy, cx) as sxx, regr_syy(cy, cx) as syy, regr_sxy(cy, cx) as sxy from lines group by all) select image_id, round(avg(sqrt(greatest(0, syy - sxy * sxy / sxx) / n)), 6) as residual, count(*) as lines from r where n >= 5 and sxx * n > 1e-10 group by image_id",
    "largest_parts": f"with {_TEXT_PX}, {_RUNS}, r as (select *, row_number() over (partition by image_id order by area desc, label) as no from runs) select image_id, label, area from r where no <= 5",
    "boundary_scan": f"with {_TEXT_PX}, s as (select image_id, x, y, coalesce((lag(g) over q + g + lead(g) over q) / 3, g) as s from px window q as (partition by image_id, y order by x)), r as (select *, min(s) over (partition by image_id, y order by x rows between 3 preceding and 1 preceding) as low, lag(s, 3) over (partition by image_id, y order by x) as back from s) select image_id, y, min(x) as x from r where s >= 160 and low < 120 and s - back >= 25 group by all",
    "area_average": f"with {_VEC_PX}, {_SIZED}, k as (select *, least(1.0::double, 50.0::double / greatest(w, h)) as z from sized), n as (select *, greatest(1, floor(w * z + 0.5))::int as nw, greatest(1, floor(h * z + 0.5))::int as nh from k), cx as (select *, unnest(range(0, nw)) as ox from n), c as (select *, unnest(range(0, nh)) as oy from cx where ox * (w::double / nw) < x + 1 and (ox + 1) * (w::double / nw) > x), v as (select *, (least(x + 1, (ox + 1) * (w::double / nw)) - greatest(x, ox * (w::double / nw))) * (least(y + 1, (oy + 1) * (h::double / nh)) - greatest(y, oy * (h::double / nh))) as wt from c where oy * (h::double / nh) < y + 1 and (oy + 1) * (h::double / nh) > y) select image_id, ox::int as x, oy::int as y, floor(sum(g * wt) / sum(wt) * 1000 + 0.317) / 1000 as g from v group by all",
    "color_saturation": f"with {_TEXT_PX}, m as (select image_id, avg(g) filter (x % 3 = 0) as a, avg(g) filter (x % 3 = 1) as b, avg(g) filter (x % 3 = 2) as c from px group by image_id) select image_id, round((greatest(a, b, c) - least(a, b, c)) / 255, 6) as saturation from m",
    "scalar_functions": f"with {_META}, s as (select *, least(1.0::double, 200.0::double / greatest(width, height)) as z from meta) select image_id, floor(width::double * height / 1e6 * 100 + 0.5) / 100 as mp, greatest(1, floor(width * z + 0.5))::int as tw, greatest(1, floor(height * z + 0.5))::int as th, (2 ** ceil(log2(width)))::int as p2, round(0.5 * (1 - cos(2 * pi() * (image_id % 64) / 63)), 9) as hann, round(file_size * 8.0::double / (width::double * height), 6) as bpp, floor(0.2989::double * (image_id % 256) + 0.5870::double * (width % 256) + 0.1140::double * (height % 256) + 0.5)::int as grey, case when image_id % 101 < 25 then 'very-bad' when image_id % 101 < 50 then 'bad' when image_id % 101 < 75 then 'good' else 'very-good' end as slider from s",
    "page_selector": "select doc_id, array_to_string(list_sort(list_distinct(list_concat([doc_id % 3 + 1], range(doc_id % 5 + 2, doc_id % 5 + 5)))), ',') as pages from documents",
    "kernel_exact": f"""with {_TEXT_PX}, {_SIZED}, s as (select *, greatest(1, floor(least(w, h) * 0.1))::int as e from sized),
        m as (select image_id, any_value(w) as w, any_value(h) as h, avg(g) as mean, coalesce(stddev_samp(g), 0) as sd, count_if(g < 128) / count(*) as fg, avg(g) filter (y < e or y >= h - e or x < e or x >= w - e) as edge,
          avg(g) filter (x >= floor(w * 0.3) and x < floor(w * 0.7) and y >= floor(h * 0.3) and y < floor(h * 0.7)) as centre, avg(g) filter (y < h // 2 and x < w // 2) as z0, avg(g) filter (y < h // 2 and x >= w // 2) as z1, avg(g) filter (y >= h // 2 and x < w // 2) as z2, avg(g) filter (y >= h // 2 and x >= w // 2) as z3 from s group by image_id),
        hh as (select image_id, g, count(*) as c from px group by all), u as (select image_id, g, sum(c) over (partition by image_id order by g) as upto, sum(c) over (partition by image_id) as n from hh), p as (select image_id, min(g) as p90 from u where upto >= floor(n * 0.9) group by image_id),
        st as (select image_id, x % 8 = 0 as ox, y % 8 = 0 as oy, abs(g - lag(g) over (partition by image_id, y order by x)) as dx, abs(g - lag(g) over (partition by image_id, x order by y)) as dy from sized where w >= 16 and h >= 16),
        dd as (select image_id, ox as grid, dx as step from st where dx is not null union all select image_id, oy, dy from st where dy is not null), b as (select image_id, avg(step) filter (grid) as a, avg(step) filter (not grid) as b from dd group by image_id)
        select m.image_id, round(mean, 6) as "brightnessAvg", round(sd, 6) as "brightnessStdevMax", round(fg, 6) as "foregroundRatio", case when h >= 20 then p90::double end as "backgroundP90", case when h >= 20 then round(centre - edge, 6) end as "shadowEdgeCenterDiff",
          case when h >= 100 then round(greatest(z0, z1, z2, z3) - least(z0, z1, z2, z3), 6) end as "zoneBrightnessDiff", round(coalesce(case when b < 0.1 then case when a > 0.5 then 10.0 else 0.0 end else greatest(0, a / b - 1) end, 0), 6) as "fftJpegBlockiness"
        from m join p using (image_id) left join b using (image_id)""",
    "spectrum_metrics": f"""with {_POWER}, high as (select image_id, sum(p) filter (r > 0.3) / any_value(e) as high from bins group by image_id),
        ring as (select image_id, least(floor(r * 10), 9) as ring, greatest(median(sqrt(p)), any_value(sqrt(e / n)) * 0.01) * 6 as t, count(*) as c from bins where r >= 0.05 group by all),
        peak as (select b.image_id, count(*) as peaks from bins b join ring g on b.image_id = g.image_id and least(floor(b.r * 10), 9) = g.ring where b.r >= 0.05 and g.c >= 3 and sqrt(b.p) > g.t group by all),
        sector as (select image_id, s, coalesce(sum(p) filter (least(floor(atan2(fy, fx) / pi() * 12), 11) = s and r >= 0.05), 0) as en from bins, range(0, 12) t(s) group by all),
        ratio as (select image_id, max(en) / nullif(median(en), 0) as ratio from sector group by all)
        select image_id, round(high, 6) as high_freq, coalesce(peaks, 0)::double as peaks, round(ratio, 4) as directional from high left join peak using (image_id) join ratio using (image_id)""",
    "component_stats": f"""with recursive {_VEC_PX}, {_RUNS}, touch as (select a.image_id, a.label as a, b.label as b from runs a join runs b on a.image_id = b.image_id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
        closed(image_id, a, b) as (select image_id, a, b from touch union select image_id, label, label from runs union select c.image_id, c.a, t.b from closed c join touch t on c.image_id = t.image_id and c.b = t.a),
        part as (select image_id, a, min(b) as root from closed group by all),
        rim as (select d.image_id, count(*) as outline from px d where g < 128 and (select count(*) from px o where o.image_id = d.image_id and o.g < 128 and abs(o.x - d.x) + abs(o.y - d.y) = 1) < 4 group by 1),
        c as (select image_id, count(distinct root) as parts from part group by 1), s as (select image_id, count(*) as area from px where g < 128 group by 1)
        select image_id, parts, area, outline from c join s using (image_id) join rim using (image_id)""",
    "seeded_shuffle": "select path, (row_number() over (order by md5(path || '#7'), path))::int as place from (select distinct path from path_labels where path is not null) order by place limit 100",
    "shuffle_places": "select path, row_number() over (order by md5(path || '#7'), path) as place from (select distinct path from path_labels where path is not null)",
    "review_sort": "select path, label_id from path_labels order by lower(path) desc nulls last, label_id limit 50",
    "review_places": "select path, label_id, row_number() over (order by lower(path) desc nulls last, label_id) as place from path_labels",
    "first_unlabelled": f"with {_LATEST}, f as (select distinct path from features where path is not null), tl(tier, x) as (values ('very-good', 0.87::double), ('good', 0.62), ('bad', 0.37), ('very-bad', 0.12)), j as (select f.path, coalesce(case when l.score >= 0 and l.score <= 1 and not isnan(l.score) then l.score end, a.x, b.x) as label from f left join latest l on f.path = l.path left join tl a on a.tier = lower(trim(l.label)) left join tl b on b.tier = {_PART(2).replace('path', 'f.path')}) select path from j where label is null order by path limit 1",
    "features_fast": _MEANS("fast", FEATURES[:15]),
    "features_thorough": _MEANS("thorough", FEATURES),
    "union_modes": "select mode, count(*) as n, count(distinct image_id) as images, count(case when mode = 'thorough' then textCharShapeCV end) as with_shape from features where mode in ('fast', 'thorough') group by mode",
    "tree_score": f"with {_SCORED} select row_id, round(score, 6) as score from scored",
    "model_select": f"with {_SCORED} select s.row_id, round(case when foregroundRatio is not null and not isnan(foregroundRatio) then s.score else 1 / (1 + exp(-(case when edgeRatio is null or isnan(edgeRatio) or edgeRatio <= 0.1 then -1 else 1 end))) end, 6) as score from scored s join features f using (row_id)",
    "regression_metrics": f"with {_SCORED} select preset, count(*) as n, round(avg(abs(label - score)), 6) as mae, round(sqrt(avg((label - score) ** 2)), 6) as rmse, round(1 - sum((label - score) ** 2) / (var_pop(label) * count(*)), 6) as r2 from {_GOOD} group by preset",
    "confusion": f"with {_SCORED} select count_if(label >= 0.5 and score >= 0.5)::bigint as tp, count_if(label < 0.5 and score < 0.5)::bigint as tn, count_if(label < 0.5 and score >= 0.5)::bigint as fp, count_if(label >= 0.5 and score < 0.5)::bigint as fn, round(avg(((label >= 0.5) = (score >= 0.5))::int), 6) as accuracy from {_GOOD}",
    "tier_metrics": f"with {_SCORED} select case when label < 0.25 then 'very-bad' when label < 0.5 then 'bad' when label < 0.75 then 'good' else 'very-good' end as tier, count(*) as n, round(avg(abs(label - score)), 6) as mae, round(avg(((label >= 0.5) = (score >= 0.5))::int), 6) as accuracy from {_GOOD} group by 1",
    "top_worst": f"with {_SCORED} select row_id, label, round(score, 6) as score, round(abs(label - score), 6) as error from {_GOOD} order by round(abs(label - score), 9) desc, row_id limit 5",
    "stratified_split": f"with {_SPLIT} select * from tiered where tier is not null",
    "semi_join_testset": f"with {_SPLIT} select mode, count(*) as n from features where path in (select path from tiered where tier is not null and test) group by mode",
    "anti_join_trainset": f"with {_SPLIT} select mode, count(*) as n from features where path is null or path not in (select path from tiered where tier is not null and test) group by mode",
    "first_labels": "select path, arg_min(label, (mode, row_id)) as label from features where label is not null and not isnan(label) group by path",
    "preflight_rules": f"with {_PRE} select codes, codes = '' as pass, count(*) as n from quick group by all",
    "preflight_vs_backend": f"with {_PRE}, {_judge(_FEATURE_ROWS)} select distinct image_id from quick where codes <> '' and image_id in (select image_id from judged where slow and pass)",
    "pages_rollup": f"with e as (select result_id, preset, unnest(pageResults) as p from results), g as (select result_id, preset, p.page as page, p.pass as ok, p.score as s from e where p.score >= 0 and p.score <= 1 and not isnan(p.score)), b as (select result_id, count(*)::int as pages, bool_and(ok) as pass, floor(list_reduce(list_prepend(0.0::double, list(s order by page)), lambda a, b: a + b) / count(*) * 100 + 0.5) / 100 as score, floor(min(s) * 100 + 0.5) / 100 as worst from g group by result_id) select result_id, pages, pass, score, worst as \"worstPageScore\", case when abs(score - 0.5) >= 0.2 then 'high' when abs(score - 0.5) >= 0.1 then 'medium' else 'low' end as confidence from b",
    "tier_summary": f"with r as (select *, {_PART(1)} as category, {_PART(2)} as tier from results) select category, tier, count(*) as n, count_if(error is null and pass)::bigint as passed, count_if(error is null and not pass)::bigint as failed, count_if(error is not null)::bigint as errors, round(min(score) filter (error is null and not isnan(score)), 6) as min_score, round(max(score) filter (error is null and not isnan(score)), 6) as max_score, round(avg(score) filter (error is null and not isnan(score)), 6) as avg_score from r group by category, tier",
    "tier_rollup": f"with r as (select *, {_PART(1)} as category, {_PART(2)} as tier from results) select category, tier, count(*) as n, count_if(error is null and pass)::bigint as passed, count_if(error is not null)::bigint as errors from r where category is not null and tier is not null group by rollup (category, tier)",
    "label_counts": "select lower(trim(label)) as label, count(*) as n, count(score) as scored from path_labels group by 1",
    "label_upsert": f"with {_LATEST} select * from latest",
    "label_precedence_join": f"with {_LATEST}, f as (select distinct path from features where path is not null), tl(tier, x) as (values ('very-good', 0.87::double), ('good', 0.62), ('bad', 0.37), ('very-bad', 0.12)) select f.path, coalesce(case when l.score >= 0 and l.score <= 1 and not isnan(l.score) then l.score end, a.x, b.x) as label from f left join latest l on f.path = l.path left join tl a on a.tier = lower(trim(l.label)) left join tl b on b.tier = {_PART(2).replace('path', 'f.path')}",
    "ocr_confidence": "with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents), c as (select doc_id, (length(w) * 13 + doc_id) % 101 as k from w) select doc_id, count(*) as words, round(median(k), 6) as median, count_if(k < 60)::bigint as low_words, median(k) < 60 as fires from c group by doc_id having count(*) >= 5",
    "uploads_windowed": _WINDOWED,
    "judged_stream": f"with {_judge(_FEATURE_ROWS)} select row_id, score, pass from judged",
    "p5_found": f"""with {_CELL_VIEW}, three as (select * from cells where column_name in ('brightnessAvg', 'fftHighFreqRatio', 'zoneSharpness0')),
        loads as (select column_name, load_id, count_if(value is null) / count(*) as share, median(value) filter (good) as med, count(distinct value) filter (good) as ds, count_if(good) as n from three where due group by all),
        mids as (select column_name, median(share) as share0, median(med) as med0 from loads group by 1)
        select column_name, load_id, 0::bigint as row_id from loads join mids using (column_name) where share > share0 + 0.2 or med < 0.65 * med0 or med > 1.5 * med0 or ds * 4 < n
        union all select distinct column_name, load_id, row_id from three where value is not null and (not good or thorough and mode = 'fast')""",
    "p5_profile": f"""with {_CELL_VIEW} select column_name, count_if(due)::bigint as due, count_if(due and value is null)::bigint as nulls, count(distinct value) filter (due and good) as distincts,
        count_if(due and good)::bigint as in_range, min(value) filter (due and good) as low, max(value) filter (due and good) as high, count_if(value is not null and (not good or not due))::bigint as impossible from cells group by 1""",
    "p5_columns": f"""with {_EVERY}, {_TEXTS} select column_name, count_if(due)::bigint as due, count_if(due and value is null)::bigint as nulls, count_if(due and good)::bigint as in_range, count(distinct value) filter (due and good) as distincts,
        min(value) filter (due and good) as low, max(value) filter (due and good) as high, null::varchar as low_text, null::varchar as high_text, count_if(value is not null and (not good or not due))::bigint as impossible from cells group by 1
        union all select column_name, {_TEXT_LINE.format('count(distinct value),')}, 0 from texts group by 1""",
    "p5_loads": f"""with {_EVERY}, {_TEXTS} select column_name, load_id, count(*) as due, count_if(value is null)::bigint as nulls, count_if(good)::bigint as in_range, count(distinct value) filter (good) as distinct_in_range,
        min(value) filter (good) as low, max(value) filter (good) as high, null::varchar as low_text, null::varchar as high_text, median(value) filter (good) as median from cells where due group by 1, 2
        union all select column_name, load_id, {_TEXT_LINE.format('count(distinct value),')}, null from texts group by 1, 2""",
}
