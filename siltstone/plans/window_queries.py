"""Event-time windows and sessions of the event table, read as a stream of files out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..streaming import windows as W
from .catalog import query, table

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
BY_TYPE = W.Windows(["event_type"], "ts", "value", width="6 hours", gap="20 minutes", delay=86_400)
BY_USER = W.Windows(["user_id"], "ts", "value", width="1 day", gap="12 hours", delay=86_400)


def fed(spark, sf_dir, spec) -> str:
    """The folder of a stream over all events, which arrive up to ten days late in eight files."""
    events = table(spark, sf_dir, "events")
    lag = F.make_dt_interval(days=F.when(F.col("event_id") % 10 == 3, F.pmod(F.xxhash64("event_id"), F.lit(10))).otherwise(0).cast("int"))
    feed = W.arrivals(events, F.col("ts") + lag, 8)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(feed._folder)
    path = shared_path(spark, "windows")
    W.windowed_stream(stream, path, f"{path}/checkpoint", spec).awaitTermination()
    return path


def _stamped(df, *keys):
    return df.select(*keys, *[F.date_format(c, STAMP).alias(c) for c in ("start", "end")], "n", F.round("total", 2).alias("total"))


@query(
    """WITH w AS (SELECT event_type, value, make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS s FROM events)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end",
  COUNT(*) AS n, round(SUM(value), 2) AS total FROM w GROUP BY event_type, s"""
)
def stream_windows(spark, sf_dir):
    """Windows on time plus late rows are the windows of all events."""
    return _stamped(W.windows(spark, fed(spark, sf_dir, BY_TYPE), BY_TYPE), "event_type")


@query(
    """WITH g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR AS gap FROM events),
 s AS (SELECT *, SUM(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(MAX(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end",
  COUNT(*) AS n, round(SUM(value), 2) AS total FROM s GROUP BY user_id, no"""
)
def stream_sessions(spark, sf_dir):
    """Sessions of every user; late rows may join sessions that were apart."""
    return _stamped(W.sessions(spark, fed(spark, sf_dir, BY_USER), BY_USER), "user_id")
