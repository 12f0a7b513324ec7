"""Readers and writers: image files, pages, labels, manifests, features, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import EXTENSIONS, FEATURES
from ..functions.scalar import image_format, is_pdf, parse_pages
from ..operators.rollup import category_preset, latest_labels, path_parts, tier_label

FILES = "path string, modificationTime timestamp, length long, content binary"
LABELS = "map<string,struct<label:string,score:double,category:string,issues:array<string>,notes:string,timestamp:string>>"


def local(path: str) -> str:
    """file: URLs and plain paths go to Spark as they are; http(s) must be staged first."""
    if path.lower().startswith(("http://", "https://")):
        raise ValueError("fetch web files into shared storage first; executors open no connections")
    return path


def read_files(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """(path, length, content, format, pdf, status) of the files below a folder.

    An unknown format is a row with status 'unsupported', never a failed job.
    """
    reader = spark.readStream.schema(FILES) if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(local(path))
    f, p = image_format(F.col("content")), is_pdf(F.col("content"))
    return files.select("path", "modificationTime", "length", "content", F.when(p, "pdf").otherwise(f).alias("format"), p.alias("pdf"), F.when(p | f.isNotNull(), "ok").otherwise("unsupported").alias("status"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, category, tier, preset) of a corpus of category/tier folders; contents are not read."""
    cat, tier = path_parts(F.col("path"))
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(local(root)).select("path", "length")
    return files.filter(known).select("path", "length", cat.alias("category"), tier.alias("tier")).filter("category is not null and tier is not null").withColumn("preset", category_preset(F.col("category")))


def _plain(path: str):
    """One spelling of local paths (the two readers differ in their slashes)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded rasters with file facts: (path, width, height, n_channels, data, file_size, format, status).

    The built-in decoder handles jpeg, png, gif, bmp and tiff; its channels are
    turned to red, green, blue(, alpha). Files it can't decode have status
    'undecoded' and no data.
    """

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, n: pd.Series) -> pd.Series:
        import numpy as np

        def turn(raw, c):
            if raw is None or c not in (3, 4):
                return raw
            a = np.frombuffer(raw, dtype=np.uint8).reshape(-1, c)
            return np.ascontiguousarray(a[:, [2, 1, 0, 3][:c]]).tobytes()

        return pd.Series([turn(r, c) for r, c in zip(data, n, strict=True)])

    images = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(local(path)).select("image.*")
    ok = F.col("width") > 0
    images = images.select(_plain("origin").alias("path"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("nChannels")).alias("n_channels"), F.when(ok, rgb("data", "nChannels")).alias("data"), F.when(ok, "ok").otherwise("undecoded").alias("status"))
    facts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(local(path)).select(_plain("path").alias("path"), F.col("length").alias("file_size"), image_format(F.col("content")).alias("format"))
    return images.join(facts, "path", "left").withColumn("density", F.lit(None).cast("double"))


Renderer = Callable[[bytes, list[int] | None], Iterator[tuple[int, int, int, int, bytes]]]


def render_pages(files: DataFrame, renderer: Renderer, pages: str = "1") -> DataFrame:
    """One row per wanted page of each PDF: (path, page, width, height, n_channels, data, file_size, error).

    ``renderer(content, pages)`` yields (page, width, height, channels, data);
    it is imported where the tasks run. A document it fails on gives one row
    with the error and no page. Pages beyond the last are not there.
    """
    wanted = parse_pages(pages)
    schema = "path string, page int, width int, height int, n_channels int, data binary, file_size long, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    rows = [(r.path, p, w, h, c, d, r.length, None) for p, w, h, c, d in renderer(r.content, wanted) if wanted is None or p in wanted]
                except Exception as e:
                    rows = [(r.path, None, None, None, None, None, r.length, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.filter("pdf").select("path", "length", "content").mapInPandas(run, schema)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records (path, label, score, category, issues, notes, labeled_at) of JSON objects keyed by path."""
    text = spark.read.option("wholetext", True).text(local(path))
    rows = text.select(F.explode(F.from_json("value", LABELS)).alias("path", "r"))
    return rows.select("path", "r.label", "r.score", "r.category", "r.issues", "r.notes", F.try_to_timestamp("r.timestamp").alias("labeled_at"))


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(path, category, tier) of a manifest (JSON lines or array); the folder scan where there is none."""
    try:
        m = spark.read.option("multiLine", True).schema("path string, category string, tier string").json(local(path))
        m.schema  # resolves the path
        return m
    except Exception:
        return scan(spark, root).select("path", "category", "tier")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """The label table after an upsert: last write per path."""
    return latest_labels(old.unionByName(new, allowMissingColumns=True))


def with_default_labels(rows: DataFrame) -> DataFrame:
    """Rows without a label get their tier folder's."""
    _, tier = path_parts(F.col("path"))
    return rows.withColumn("label", F.coalesce("label", tier_label(tier)))


def write_features(rows: DataFrame, path: str) -> None:
    """Feature CSV with header; quotes doubled, NaN and null as empty."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in FEATURES]
    rows.select("path", "preset", "mode", "label", *cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Feature CSVs, older ones without some columns too; empty cells are null. Raises on missing names."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("path", "preset", "mode")), *(T.StructField(c, T.DoubleType()) for c in ("label", *FEATURES))])
    out = None
    for p in paths:
        head = spark.read.option("header", True).csv(p).columns
        missing = {"path", "label"} - set(head)
        if missing:
            raise ValueError(f"{p} lacks {sorted(missing)}")
        raw = spark.read.option("header", True).option("escape", '"').csv(p)
        part = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in head])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, sorted by path across files."""
    results.orderBy("path").write.mode("overwrite").json(path)
