"""Structured Streaming twins of the incremental jobs: delta files in, merged tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state as S
from ..operators.chunking import chunk_documents
from ..operators.search import merge_chunks
from ..schemas import DOCUMENT
from ..sources import tables


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Document delta files as they arrive, read once each."""
    reader = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n")
    return reader.option("recursiveFileLookup", "true").json(folder)


def first_seen_urls(stream: DataFrame, at: str = "crawled_at", late: str = "1 day") -> DataFrame:
    """One row per URL within the watermark; state is dropped once it has passed."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["url"])


def _start(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame], None]) -> StreamingQuery:
    def batch(rows: DataFrame, batch_id: int) -> None:
        merge(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(
    documents: DataFrame, index_path: str, checkpoint: str, embed: Callable | None = None
) -> StreamingQuery:
    """Chunk arriving documents and merge them into the stored chunk table.

    Chunks replace their namesakes, so a batch that runs twice after a failure changes nothing.
    """

    def merge(rows: DataFrame) -> None:
        chunks = chunk_documents(rows)
        if embed is not None:
            chunks = chunks.withColumn("embedding", embed(F.col("content")))
        tables.merge_into(rows.sparkSession, index_path, chunks, merge_chunks)

    return _start(documents, checkpoint, merge)


def state_stream(updates: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Merge arriving state updates into the stored crawl state (idempotent per batch)."""

    def merge(rows: DataFrame) -> None:
        spark = rows.sparkSession
        current = tables.read_snapshot(spark, state_path)
        if current is None:
            from ..schemas import STATE

            current = spark.createDataFrame([], STATE)
        tables.write_snapshot(S.upsert_state(current, rows), state_path)

    return _start(updates, checkpoint, merge)
