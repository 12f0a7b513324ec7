"""Column expressions: rounding, sizes, presets, formats, pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PRESETS, THRESHOLDS, TIER_LABELS


def present(c: Column) -> Column:
    """NaN as null, so that it never reaches a comparison."""
    return F.when(~F.isnan(c), c)


def half_up(c: Column, digits: int = 2) -> Column:
    """Round half towards plus infinity on the double itself (not on its decimal text)."""
    f = float(10**digits)
    return F.floor(c * F.lit(f) + F.lit(0.5)) / F.lit(f)


def megapixels(width: Column, height: Column) -> Column:
    return width * height / F.lit(1e6)


def bits_per_pixel(size: Column, width: Column, height: Column) -> Column:
    return F.when(width * height > 0, size * 8.0 / (width * height)).otherwise(0.0)


def detect_preset(width: Column, height: Column) -> Column:
    """receipt for long strips, card for small card-shaped images, else document."""
    ratio = width / F.when(height == 0, F.lit(1)).otherwise(height)
    strip = (ratio < 0.4) | (ratio > 2.5)
    card = (ratio.between(1.3, 1.9) | ratio.between(0.53, 0.77)) & (megapixels(width, height) < 2.0)
    return F.when(strip, "receipt").when(card, "card").otherwise("document")


def threshold(name: str, preset: Column, overrides: dict | None = None) -> Column:
    """A threshold of the row's preset: user value, else preset value, else default."""
    if overrides and name in overrides:
        return F.lit(float(overrides[name]))
    out = None
    for p, changed in PRESETS.items():
        if name in changed and changed[name] != THRESHOLDS[name]:
            out = F.when(preset == p, F.lit(changed[name])) if out is None else out.when(preset == p, F.lit(changed[name]))
    return F.lit(THRESHOLDS[name]) if out is None else out.otherwise(F.lit(THRESHOLDS[name]))


def confidence(score: Column, limit: Column) -> Column:
    far = F.abs(score - limit)
    return F.when(far >= 0.2, "high").when(far >= 0.1, "medium").otherwise("low")


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.2989 * r + 0.5870 * g + 0.1140 * b + 0.5).cast("int")


def fit_inside(width: Column, height: Column, side: int) -> tuple[Column, Column]:
    """Size of a thumbnail within side x side, never enlarged, at least 1 x 1."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    one = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int")
    return one(width), one(height)


def next_pow2(n: Column) -> Column:
    """Smallest power of two from n up; 1 for n <= 1. By shifts, so exact."""
    m = n.cast("long") - 1
    for s in (1, 2, 4, 8, 16):
        m = m.bitwiseOR(F.shiftright(m, s))
    return F.when(n <= 1, F.lit(1)).otherwise(m + 1).cast("int")


def hann(i: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(1.0)).otherwise(0.5 * (1 - F.cos(F.lit(2 * 3.141592653589793) * i / (n - 1))))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def image_format(content: Column) -> Column:
    """Format by leading bytes; null when none of the supported ones."""
    head, brand = F.hex(F.substring(content, 1, 12)), F.hex(F.substring(content, 9, 4))
    text = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("52494646") & (brand == "57454250"), "webp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(F.substring(head, 9, 8) == "66747970", F.when(brand.isin("61766966", "61766973"), "avif").when(brand.isin("68656963", "68656978", "6D696631", "68657663"), "heif"))
        .when(text.contains("<svg"), "svg")
    )


def tier_of_slider(v: Column) -> Column:
    return F.when(v < 25, "very-bad").when(v < 50, "bad").when(v < 75, "good").otherwise("very-good")


def tier_label(tier: Column) -> Column:
    out = None
    for t, x in TIER_LABELS.items():
        out = F.when(tier == t, F.lit(x)) if out is None else out.when(tier == t, F.lit(x))
    return out


def label_tier(label: Column) -> Column:
    """Quarter of the 0..1 scale, left-closed; null outside."""
    return F.when((label >= 0) & (label < 0.25), "very-bad").when((label >= 0.25) & (label < 0.5), "bad").when((label >= 0.5) & (label < 0.75), "good").when((label >= 0.75) & (label < 1.01), "very-good")


def parse_pages(spec: str) -> list[int] | None:
    """Page numbers of '1', '1-5', '1,4,8-12'; None for 'all'. Sorted, each once.

    Ends of a range are read up to the first other character, empty parts are
    skipped; an empty list, page 0, a falling range or other text is an error.
    """
    text = spec.strip().lower()
    if text == "all":
        return None
    pages: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        ends = part.split("-") if "-" in part else None
        if ends:
            read = [re.match(r"\s*(\d+)", e) for e in ends[:2]]
            if not all(read):
                raise ValueError(f"not a page range: {part}")
            a, b = (int(m[1]) for m in read)
            if a < 1 or b < a:
                raise ValueError(f"not a page range: {part}")
            pages.update(range(a, b + 1))
        else:
            if not re.fullmatch(r"\d+", part) or int(part) < 1:
                raise ValueError(f"not a page number: {part}")
            pages.add(int(part))
    if not pages:
        raise ValueError("no pages named")
    return sorted(pages)


def pages_of(spec: Column) -> Column:
    """The same for a column of well-formed specs, as a sorted array; null for 'all'."""
    parts = F.filter(F.transform(F.split(F.lower(F.trim(spec)), ","), lambda p: F.trim(p)), lambda p: p != "")
    span = lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.when(F.lower(F.trim(spec)) != "all", F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span)))))
