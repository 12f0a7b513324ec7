"""The plan on streams: stateless judging, and roll-ups over arrival time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..session import own_folder


def judged(stream: DataFrame, **options) -> DataFrame:
    """Results of a stream of metric rows; the same projection as in batch."""
    return rules.judge(stream, **options)


def pass_rates(results: DataFrame, time: str, passed: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, passed) per window of arrival time. On a stream, rows later
    than ``late`` are left out and a window comes out once it is closed."""
    return results.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(passed)).alias("passed")).select(F.col("w.start").alias("start"), by, "n", "passed")


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder."""
    at = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
