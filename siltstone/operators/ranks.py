"""Ranking helpers that stay exact when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key under a total order.

    The filter on ``row_number`` lets Spark keep only ``k`` rows per key inside every input
    partition before the shuffle (window group limit), so a hot key ships k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def hash_bucket(key: Column | str, digits: int = 3) -> Column:
    """Leading hex digits of the key's MD5: an even split that any SQL engine can repeat."""
    return F.substring(F.md5(F.col(key) if isinstance(key, str) else key), 1, digits)


def ordinals(
    df: DataFrame, keys: Sequence[str], leading: Sequence[str], unique: str, name: str = "ordinal", digits: int = 3
) -> DataFrame:
    """Exact 1-based position of each row within its key, without one task per key.

    Rows of a key are ordered by ``leading``, then by a hash bucket of ``unique``, then by
    ``unique``. Positions inside a bucket come from a window over the bucket alone; the offset
    of a bucket is the running sum of bucket sizes, computed on the small table of counts.
    """
    split = df.withColumn("_bucket", hash_bucket(unique, digits))
    group = [*keys, *leading, "_bucket"]
    sizes = split.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy(*leading, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*group).orderBy(unique)
    return (
        split.withColumn("_local", F.row_number().over(local))
        .join(offsets, group)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the smallest order columns per key, as a plain aggregate.

    ``min`` over a struct combines map-side, so a key with a third of all rows still
    shuffles one row per task (a ranking window would gather the whole key).
    """
    packed = df.groupBy(*keys).agg(F.min(F.struct(*order, *values)).alias("_first"))
    return packed.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *values]])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the largest order columns per key, as a plain aggregate."""
    packed = df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_last"))
    return packed.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [*order, *values]])


def split_by_match(rows: DataFrame, marks: DataFrame, keys: Sequence[str], count: str = "n", share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``rows`` joined to ``marks``, and the rows without a mark, whatever share of the rows one key holds.

    ``marks`` is a written table with one row per key (no nulls in ``keys``), and ``count`` says how many rows
    hold the key. Keys with more than one in ``share`` of all counted rows are fewer than ``share``, so they
    travel to the rows; all other keys meet in a shuffle in which no key is large. The row without marks of a
    broadcast key cannot exist, so the second result is an anti join against both.
    """
    total = marks.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) > total / share
    hot, cold = marks.filter(large), marks.filter(~large)
    if hot.isEmpty():
        return rows.join(marks, list(keys)), rows.join(marks.select(*keys), list(keys), "left_anti")
    hot, rest = F.broadcast(hot), rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    met = rows.join(hot, list(keys)).unionByName(rest.join(cold, list(keys)))
    return met, rest.join(cold.select(*keys), list(keys), "left_anti")
