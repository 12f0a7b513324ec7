"""Session helpers: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a
    folder of our own is made, and it is removed when the process ends.
    """
    named = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.inkgauge.own.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_DIR_KEY} to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="inkgauge-")
        spark.conf.set("spark.inkgauge.own.dir", own)
        import shutil

        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


_folders: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/inkgauge-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    from pyspark import SparkContext

    try:
        jvm = SparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # the JVM is gone already; the folder's name tells whose it was
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends there, a lost executor costs nothing but its running
    tasks, values of nondeterministic expressions are fixed, and the planner
    learns the true size (which is what a broadcast is decided on).
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """More tasks for a scan of very few files, before work that is heavy per row.

    A plan that has a shuffle, or at least half as many partitions as there are
    cores, is left as it is, so a large table is never moved for this. Hashing
    by a key keeps the result the same when a task is run again.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.toString() or df._jdf.queryExecution().toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, key)
