"""Registry of runnable queries: a Spark function and, where possible, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from . import answer_queries, crawl_queries, history_queries, page_queries, report_queries  # noqa: F401
    from . import search_queries, segment_queries, state_queries, stream_queries, url_queries, vector_queries, window_queries  # noqa: F401

    return QUERIES
