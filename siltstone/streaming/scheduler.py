"""Start times of requests as they arrive in a stream, so that no host is asked too often.

What a batch leaves behind is the time at which each busy host is free again, in a folder named by the batch. A batch reads the
newest state before its own number, so one that runs again after a failure gives out the same times. A host that is free
by the clock needs no state and expires. Positions within a host come from `ordinals`, which needs no task per host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.frontier import request_slots

STATE = "host string, free_at double, batch int"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def busy_hosts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``host, free_at`` as the newest batch (or the newest below ``before``) left them."""
    if not _exists(spark, f"{path}/clock"):
        return spark.createDataFrame([], "host string, free_at double")
    done = spark.read.parquet(f"{path}/clock")
    newest = done.filter(F.col("batch") < before) if before is not None else done
    last = newest.agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], "host string, free_at double")
    return spark.read.schema(STATE).parquet(f"{path}/busy").filter(F.col("batch") == last).select("host", "free_at")


def _clock(spark: SparkSession, path: str, before: int) -> float:
    if not _exists(spark, f"{path}/clock"):
        return 0.0
    return spark.read.parquet(f"{path}/clock").filter(F.col("batch") < before).agg(F.max("now")).first()[0] or 0.0


def schedule_stream(
    requests: DataFrame, delays: DataFrame, path: str, checkpoint: str, default_delay: float
) -> StreamingQuery:
    """Give every arriving request (``url, depth, asked_at``: seconds) a start; read them with `scheduled`.

    Requests of a batch go by depth, then in hash order of their URLs; each starts no sooner than the clock, which is the
    largest ``asked_at`` so far, and its host's delay after the one before. ``delays`` is ``host, crawl_delay``; the
    longer of it and the default applies. Every row with a URL is a request, repeated or not.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = _clock(spark, path, batch_id)
        rows = rows.persist()
        try:
            now = max(before, rows.agg(F.max("asked_at")).first()[0] or 0.0)
            busy = busy_hosts(spark, path, batch_id).select(F.col("host").alias("_host"), "free_at")
            slots = request_slots(rows.dropna(subset=["url"]), delays, default_delay)
            free = F.greatest(F.coalesce("free_at", F.lit(now)), F.lit(now))
            placed = slots.join(busy, F.col("host").eqNullSafe(F.col("_host")), "left")
            placed = placed.select("url", "host", "depth", "delay", (free + F.col("start_at")).alias("start_at"))
            placed.write.mode("overwrite").parquet(f"{path}/scheduled/batch={batch_id}")
            given = spark.read.schema(placed.schema).parquet(f"{path}/scheduled/batch={batch_id}")
            after = given.groupBy("host").agg(F.max(F.col("start_at") + F.col("delay")).alias("free_at"))
            left = busy.select(F.col("_host").alias("host"), "free_at").unionByName(after).groupBy("host").agg(F.max("free_at").alias("free_at"))
            left.filter(F.col("free_at") > now).write.mode("overwrite").parquet(f"{path}/busy/batch={batch_id}")
            clock = spark.range(1).select(F.lit(float(now)).alias("now"))
            clock.write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")  # last: the batch counts from here on
        finally:
            rows.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scheduled(spark: SparkSession, path: str) -> DataFrame:
    """``url, host, depth, delay, start_at`` of all requests."""
    return spark.read.parquet(f"{path}/scheduled").drop("batch")
