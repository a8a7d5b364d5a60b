"""What the operators share: reading inputs, Arrow functions over rows, and row conversion."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """The id and the text under fixed names; other columns of the input cannot clash with them."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *others)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes: texts are long, and a batch stands in memory several times on either side.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` turns an iterator of input rows (tuples) into output rows, Arrow batch by Arrow batch.

    ``fn`` is called once per task, so it may keep tables or caches of bounded size. Output is
    sent on in batches of at most 1,024 rows and about 4 MB.
    """

    small_batches(df.sparkSession)
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        try:
            for row in fn(_rows(batches)):
                rows.append(row)
                size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
                if len(rows) >= 1024 or size > BATCH_BYTES:
                    yield _batch(rows, target)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, target)
        finally:  # workers live on for other tasks
            rows.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches, a few hundred at a time, so that long texts are never all copied at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*[column.to_pylist() for column in part.columns])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
