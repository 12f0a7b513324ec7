"""The quality engine: options and whole pipelines from rasters to results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import detect_preset, half_up, megapixels
from ..operators import kernels, rollup, rules


@dataclass(frozen=True)
class Options:
    """What a check does. ``on_error`` 'pass' lets rows that can't be analysed
    pass with score 1 (their ``status`` says so); 'fail' rejects them."""

    mode: str = "fast"
    preset: str = "auto"
    thresholds: dict[str, float] = field(default_factory=dict)
    penalties: dict[str, float] = field(default_factory=dict)
    pages: str = "1"
    detect_bounds: bool = True
    boundary: Column | None = None  # a detector of the user's: STRUCT<detected, region, confidence>; thorough mode only
    scorer: Column | None = None
    plugins: dict[str, kernels.Plugin] = field(default_factory=dict)
    plugin_issues: list[Column] = field(default_factory=list)
    on_error: str = "pass"

    def __post_init__(self):
        if self.mode not in ("fast", "thorough"):
            raise ValueError(f"mode {self.mode}: fast or thorough")
        if self.preset not in ("auto", "document", "receipt", "card"):
            raise ValueError(f"preset {self.preset}: auto, document, receipt or card")


class QualityEngine:
    """A DataFrame of images in, a DataFrame of results out."""

    def __init__(self, options: Options | None = None, **changes: Any):
        self.options = replace(options or Options(), **changes)

    def with_options(self, **changes: Any) -> QualityEngine:
        """A checker with some options replaced whole (thresholds are not merged)."""
        return QualityEngine(self.options, **changes)

    def judge(self, metrics: DataFrame) -> DataFrame:
        """Results of rows that already hold metrics."""
        o = self.options
        return rules.judge(metrics, o.preset, o.mode, o.thresholds, o.penalties, o.scorer, extra=o.plugin_issues)

    def check(self, images: DataFrame) -> DataFrame:
        """Results of rasters (width, height, n_channels, data, file_size, format, density, …).

        Two narrow stages: one kernel per image, then expressions. The preset
        of 'auto' follows the found page, else the image.
        """
        o = self.options
        rows = images
        if o.boundary is not None and o.mode == "thorough":
            rows = rows.withColumn("boundary", o.boundary)
        own = "boundary" in rows.columns
        meta = rules.metadata_metrics(kernels.raster_metrics(rows, o.mode, plugins=o.plugins, find_page=o.detect_bounds and not own))
        if "boundary" in meta.columns:
            w, h = F.coalesce("boundary.region.width", F.col("width").cast("double")), F.coalesce("boundary.region.height", F.col("height").cast("double"))
            if o.preset == "auto":
                meta = meta.withColumn("preset", detect_preset(w, h))
        judged = self.judge(meta)
        bad = F.col("error").isNotNull()
        fallback = {"pass": F.lit(o.on_error == "pass"), "score": F.lit(1.0 if o.on_error == "pass" else 0.0), "confidence": F.lit("high")}
        judged = judged.withColumns({c: F.when(bad, v).otherwise(F.col(c)) for c, v in fallback.items()})
        judged = judged.withColumn("issues", F.when(bad, F.array().cast(rules.ISSUE)).otherwise(F.col("issues")))
        meta_out = F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), half_up(megapixels(F.col("width"), F.col("height"))).alias("megapixels"), F.col("format"), F.col("file_size").alias("fileSize"))
        return judged.withColumn("metadata", meta_out).withColumn("status", F.when(bad, "error").otherwise("ok"))

    def check_pages(self, pages: DataFrame, doc: str = "path") -> DataFrame:
        """Results of documents from one raster per page: one shuffle, on the document."""
        return rollup.pages(self.check(pages), doc, "page", self.options.thresholds)

    def preflight(self, images: DataFrame) -> DataFrame:
        """The quick check of rasters on 200-pixel thumbnails."""
        return rules.preflight(thumbnail_metrics(images), {}, self.options.scorer)


def thumbnail_metrics(images: DataFrame) -> DataFrame:
    """megapixels, fileSize and the thumbnail metrics of rasters; images below the least size aren't decoded."""
    names = ["brightnessAvg", "brightnessStdevMax", "laplacianStdev", "edgeRatio", "foregroundRatio", "blankStdevMax"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(width: pd.Series, height: pd.Series, n: pd.Series, data: pd.Series) -> pd.DataFrame:
        def one(w, h, c, raw):
            if raw is None or w * h < 280_000 or len(raw) != w * h * c:
                return {}
            return kernels.preflight_metrics(np.frombuffer(raw, dtype=np.uint8).reshape((h, w) if c == 1 else (h, w, c)))

        made = [one(*r) for r in zip(width, height, n, data, strict=True)]
        return pd.DataFrame({k: pd.Series([m.get(k) for m in made], dtype=float) for k in names})

    t = images.withColumn("_t", run("width", "height", "n_channels", "data"))
    return t.withColumns({k: F.col(f"_t.{k}") for k in names} | {"megapixels": megapixels(F.col("width"), F.col("height")), "fileSize": F.col("file_size").cast("double")}).drop("_t", "data")
