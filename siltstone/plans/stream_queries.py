"""The incremental state merge run as a stream over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import tables
from ..streaming.ingest import state_stream
from .catalog import query, table


@query(
    """SELECT 'https://users.example.com/' || user_id AS url, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_crawled, arg_max(CAST(floor(value) AS INTEGER), event_id) AS status,
  arg_max(md5(props), event_id) FILTER (event_type = 'view') AS content_hash FROM events GROUP BY user_id"""
)
def stream_state_merge(spark, sf_dir):
    """Event files arrive as a stream; every batch is merged into the crawl state."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    view = F.col("event_type") == "view"
    always = F.array(F.lit("status"), F.lit("last_crawled"))
    updates = events.select(
        F.concat(F.lit("https://users.example.com/"), "user_id").alias("url"), F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_crawled"), F.floor("value").cast("int").alias("status"),
        F.md5("props").alias("content_hash"),
        F.when(view, F.concat(always, F.array(F.lit("content_hash")))).otherwise(always).alias("set_columns"),
        *[F.lit(None).cast("string").alias(c) for c in ("canonical_url", "etag", "last_modified", "title", "last_changed", "error")],
    )
    base = f"{shared_dir(spark).rstrip('/')}/siltstone/stream-{uuid.uuid4().hex}"
    state_stream(updates, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    merged = tables.read_snapshot(spark, f"{base}/state")
    return merged.select("url", "first_seen", "last_crawled", "status", "content_hash")
