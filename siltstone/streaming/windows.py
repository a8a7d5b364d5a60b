"""Event-time windows and sessions over a stream, with late rows kept instead of dropped.

Every batch is aggregated into partial windows and sessions in a folder of its own, named by the batch: a batch
that runs again after a failure replaces what it wrote. The watermark of a batch is the largest event time of the batches
before it, less the delay; it only grows. Rows behind it are late: they are written to a table as they are, and their
partial results are marked, so a reader has the windows on time, the corrections, or both. Reading adds up
partial rows, a few per window and batch; `compact` folds those of old batches into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import materialise


@dataclass(frozen=True)
class Windows:
    """What to count: rows per ``keys`` in windows of ``width`` and in sessions that end after ``gap`` without a row.

    ``at`` is the event time, ``value`` a numeric column to add up, ``delay`` how far a row may lag behind the newest one
    (seconds). Rows without a time belong to no window and go to the late table. Null keys are a key.
    """

    keys: Sequence[str]
    at: str
    value: str
    width: str = "1 hour"
    gap: str = "30 minutes"
    delay: int = 3600

    def windows(self, rows: DataFrame) -> DataFrame:
        return self._counted(rows, F.window(self.at, self.width))

    def sessions(self, rows: DataFrame) -> DataFrame:
        return self._counted(rows, F.session_window(self.at, self.gap))

    def _counted(self, rows: DataFrame, window) -> DataFrame:
        grouped = rows.filter(F.col(self.at).isNotNull()).groupBy("late", *self.keys, window.alias("w"))
        counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total"))
        return counted.select("late", *self.keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def watermark(spark: SparkSession, path: str, delay: int, before: int | None = None):
    """The watermark after all batches, or as batch ``before`` sees it; None until a batch had a timed row."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/progress")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    seen = _read(spark, path, "progress")
    if before is not None:
        seen = seen.filter(F.col("batch") < before)
    return seen.agg((F.max("newest") - F.make_dt_interval(secs=F.lit(delay))).alias("w")).first().w


def windowed_stream(stream: DataFrame, path: str, checkpoint: str, spec: Windows) -> StreamingQuery:
    """Process what has arrived: partial ``windows`` and ``sessions``, ``late`` rows and ``progress`` under ``path``.

    Partial sessions of a key are merged inside every task before they move
    (``spark.sql.sessionWindow.merge.sessions.in.local.partition``), so a hot key sends sessions, not rows.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        limit = watermark(spark, path, spec.delay, before=batch_id)
        behind = F.lit(False) if limit is None else F.col(spec.at) < F.lit(limit)
        marked = rows.withColumn("late", F.coalesce(behind, F.lit(False))).persist()
        try:
            write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            write(spec.windows(marked), "windows")
            write(spec.sessions(marked), "sessions")
            write(marked.filter(F.col("late") | F.col(spec.at).isNull()).drop("late"), "late")
            write(marked.agg(F.max(spec.at).alias("newest")), "progress")  # last: a batch counts once this is there
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str, name: str, late: bool) -> DataFrame:
    parts = _read(spark, path, name)
    return parts if late else parts.filter("NOT late")


def windows(spark: SparkSession, path: str, spec: Windows, late: bool = True) -> DataFrame:
    """``keys, start, end, n, total, n_late, closed``; without ``late`` rows as an append-only sink would have had them."""
    parts = _parts(spark, path, "windows", late)
    added = parts.groupBy(*spec.keys, "start", "end").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late")
    )
    return added.withColumn("closed", F.coalesce(F.col("end") <= F.lit(watermark(spark, path, spec.delay)), F.lit(False)))


def merge_sessions(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sessions that overlap become one: a session starts where no earlier one of its key reaches."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = reach.isNull() | (F.col("start") >= reach)
    numbered = parts.withColumn("_first", first).withColumn("_no", F.sum(F.col("_first").cast("int")).over(order))
    return numbered.groupBy(*keys, "_no").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"),
    ).drop("_no")


def sessions(spark: SparkSession, path: str, spec: Windows, late: bool = True) -> DataFrame:
    """``keys, start, end, n, total, n_late, closed``. A late row may join two sessions that were apart before it came."""
    found = merge_sessions(_parts(spark, path, "sessions", late), spec.keys)
    return found.withColumn("closed", F.coalesce(F.col("end") <= F.lit(watermark(spark, path, spec.delay)), F.lit(False)))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came behind the watermark, and those without a time, with the ``batch`` they came in."""
    return _read(spark, path, "late")


def compact(spark: SparkSession, path: str, spec: Windows, to: str) -> None:
    """Copy everything to ``to`` with one partial row per window, or session, and lateness instead of one per batch.

    Sessions stay apart by lateness, so readers with and without late rows see what they saw before. Batch numbers of
    the copy end with the newest batch, so the stream goes on from its checkpoint with the new path.
    """
    last = _read(spark, path, "progress").agg(F.max("batch")).first()[0]
    parts = _parts(spark, path, "windows", True)
    whole = parts.groupBy("late", *spec.keys, "start", "end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole.write.parquet(f"{to}/windows/batch={last}")
    joined = merge_sessions(_parts(spark, path, "sessions", True), ["late", *spec.keys]).drop("n_late")
    joined.write.parquet(f"{to}/sessions/batch={last}")
    late_rows(spark, path).drop("batch").write.parquet(f"{to}/late/batch={last}")
    _read(spark, path, "progress").agg(F.max("newest").alias("newest")).write.parquet(f"{to}/progress/batch={last}")


def arrivals(rows: DataFrame, order, files: int) -> DataFrame:
    """``rows`` written as about ``files`` files in the order of ``order``, as a feed that delivers them would."""
    return materialise(rows.repartitionByRange(files, order), "arrivals")
