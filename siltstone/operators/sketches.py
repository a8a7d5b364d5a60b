"""Corpus reports from mergeable sketches, stored per section and day.

A day's texts are read once, when they arrive. What is kept is a row per section and day: sums, a HyperLogLog of the
terms, a KLL sketch of the words per document and the frequent terms. Any report over days and sections
merges such rows, so a new crawl never reads old texts again.

Bounds, with the settings below: distinct terms within 4 % (five standard errors at 2^14 registers), the share of documents
below a quantile within 2 % of the one asked for, a term's count at most ``TERM_ERROR`` of all term occurrences off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERS = 14
QUANTILE_SIZE = 800
TRACKED = 10_000
DISTINCT_ERROR = 0.04
RANK_ERROR = 0.02
TERM_ERROR = 0.001


def day_sketches(docs: DataFrame) -> DataFrame:
    """``section, day`` with sketches of ``docs`` (``section, day, terms, words``: an array of terms and a count).

    Both aggregates combine map-side, sketches included, so a section with a third of all documents is no hot group.
    Null terms and null word counts are left out; sections and days may be null.
    """
    per_doc = docs.groupBy("section", "day").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.min("words").alias("least"), F.max("words").alias("most"),
        F.kll_sketch_agg_bigint(F.col("words").cast("long"), QUANTILE_SIZE).alias("quantiles"),
    )
    terms = docs.select("section", "day", F.explode("terms").alias("term")).filter("term IS NOT NULL")
    per_term = terms.groupBy(F.col("section").alias("_section"), F.col("day").alias("_day")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.hll_sketch_agg("term", REGISTERS).alias("distinct_terms"),
        F.expr(f"approx_top_k_accumulate(term, {TRACKED})").alias("frequent"),
    )
    same = F.col("section").eqNullSafe(F.col("_section")) & F.col("day").eqNullSafe(F.col("_day"))
    return per_doc.join(per_term, same, "left").drop("_section", "_day")


def store_days(docs: DataFrame, path: str) -> None:
    """Write the sketches of the days in ``docs``; a day that is there already is replaced, others are not touched."""
    rows = day_sketches(docs).withColumn("crawl_day", F.coalesce(F.col("day").cast("string"), F.lit("none")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_day").parquet(path)


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of all rows of ``stored`` with the same ``by``, merged."""
    return stored.groupBy(*by).agg(
        F.sum("documents").alias("documents"), F.sum("words").alias("words"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.sum("occurrences").alias("occurrences"),
        F.hll_union_agg("distinct_terms").alias("distinct_terms"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def report(spark: SparkSession, path: str, by: list[str], ranks: tuple[float, ...] = (0.5, 0.9), k: int = 10) -> DataFrame:
    """``by, documents, words, least, most, occurrences``, estimates ``terms``, ``q<percent>`` and ``top`` (term, n)."""
    rows = merged(spark.read.parquet(path), by)
    return rows.select(
        *by, "documents", "words", "least", "most", "occurrences", F.hll_sketch_estimate("distinct_terms").alias("terms"),
        *[F.kll_sketch_get_quantile_bigint("quantiles", F.lit(r)).alias(f"q{round(r * 100)}") for r in ranks],
        F.transform(F.expr(f"approx_top_k_estimate(frequent, {k})"), lambda e: F.struct(e["item"].alias("term"), e["count"].alias("n"))).alias("top"),
    )


def within(estimate: Column, exact: Column, error: float) -> Column:
    return F.abs(estimate - exact) <= error * exact
