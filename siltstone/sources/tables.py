"""Snapshot tables on shared storage: versioned directories with an atomic pointer swap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished."""
    fs, Path = _filesystem(spark, path)
    return fs.exists(Path(f"{path}/_SUCCESS"))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest complete version (Spark's ``_SUCCESS`` mark) under a snapshot path."""
    fs, Path = _filesystem(spark, path)
    if not fs.exists(Path(path)):
        return None
    found = [
        int(s.getPath().getName()[1:])
        for s in fs.listStatus(Path(path))
        if s.getPath().getName().startswith("v") and fs.exists(Path(f"{s.getPath()}/_SUCCESS"))
    ]
    return max(found, default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    version = latest_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write the next version. Readers see it only once it is complete; a failed write that left
    a partial directory is overwritten by the next attempt."""
    spark = df.sparkSession
    version = (latest_version(spark, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    return spark.read.parquet(f"{path}/v{version}")


def merge_into(
    spark: SparkSession, path: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """New snapshot = ``merge(current, incoming)``; the first load is just the incoming rows."""
    current = read_snapshot(spark, path)
    return write_snapshot(incoming if current is None else merge(current, incoming), path)
