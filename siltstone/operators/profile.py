"""Corpus report: aggregates and rankings over documents. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .ranks import top_k_per


def counted(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def with_share(counts: DataFrame, total: DataFrame) -> DataFrame:
    """Add ``pct`` of a one-row total (scalar subquery, so nothing is collected or crossed)."""
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total.scalar(), 6))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """One row: documents by type and the spread of words per page."""
    page = F.col("source_type") == "web_page"
    words = F.when(page, F.coalesce("word_count", F.lit(0)))
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(page).alias("pages"),
        F.count_if(F.col("source_type") == "linked_document").alias("assets"),
        F.sum(words).alias("total_words"),
        F.median(words).alias("median_words"),
        F.max(words).alias("max_words"),
        F.min(words).alias("min_words"),
        F.count_if(words < 100).alias("thin_pages"),
    )


def language_counts(pages: DataFrame, k: int = 5) -> DataFrame:
    key = F.coalesce(F.nullif("language", F.lit("")), F.lit("(unset)"))
    return counted(pages, key, "language").orderBy(F.desc("n"), "language").limit(k)


def section_shares(pages: DataFrame, k: int = 25) -> DataFrame:
    counts = counted(pages, U.url_section("url"), "section").orderBy(F.desc("n"), "section").limit(k)
    return with_share(counts, pages.agg(F.count(F.lit(1))))


def modified_year(modified: Column, published: Column) -> Column:
    """Year of an ISO or an HTTP date, else ``(unknown)``."""
    blank = lambda c: F.nullif(c, F.lit(""))
    raw = F.trim(F.coalesce(blank(modified), blank(published), F.lit("")))
    http = F.regexp_replace(raw, r"^[A-Za-z]+,\s*", "")
    parsed = F.try_to_timestamp(F.regexp_replace(http, r"\s*(GMT|UTC|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.when(raw.rlike(r"^\d{4}"), F.substring(raw, 1, 4)).otherwise(
        F.coalesce(F.year(parsed).cast("string"), F.lit("(unknown)"))
    )


def freshness(pages: DataFrame, k: int = 12) -> DataFrame:
    year = modified_year(F.col("modified_at"), F.col("published_at"))
    return counted(pages, year, "year").orderBy(F.desc("year")).limit(k)


def host_shares(docs: DataFrame) -> DataFrame:
    host = F.coalesce(F.nullif(U.url_host("url"), F.lit("")), F.lit("?"))
    return with_share(counted(docs, host, "host"), docs.agg(F.count(F.lit(1)))).orderBy(F.desc("n"), "host")


def topic_counts(docs: DataFrame, k: int = 25) -> DataFrame:
    """Bigrams over title and headings, read as one text."""
    surface = F.array_join(F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("headings", F.array())), " . ")
    pairs = docs.select(F.explode(T.bigrams(T.report_terms(surface))).alias("phrase"))
    return counted(pairs, F.col("phrase"), "phrase").orderBy(F.desc("n"), "phrase").limit(k)


def term_frequencies(docs: DataFrame, k: int = 25, text: str = "text") -> DataFrame:
    """Terms by the number of documents that hold them; whole texts are read."""
    terms = docs.select(F.explode(F.array_distinct(T.report_terms(F.coalesce(text, F.lit(""))))).alias("term"))
    return counted(terms, F.col("term"), "term").orderBy(F.desc("n"), "term").limit(k)


def largest(pages: DataFrame, k: int = 10, tie: str = "url") -> DataFrame:
    return pages.orderBy(F.desc(F.coalesce("word_count", F.lit(0))), F.col(tie)).limit(k)


def samples_per_section(pages: DataFrame, sections: int = 10, k: int = 5, tie: str = "url") -> DataFrame:
    """Longest ``k`` pages of the ``sections`` most frequent sections."""
    keyed = pages.withColumn("section", U.url_section("url"))
    top = counted(keyed, F.col("section"), "section").orderBy(F.desc("n"), "section").limit(sections).select("section")
    kept = keyed.join(top, "section", "left_semi")
    return top_k_per(kept, ["section"], [F.desc(F.coalesce("word_count", F.lit(0))), F.col(tie)], k)


def asset_types(assets: DataFrame) -> DataFrame:
    kind = F.coalesce("content_type", F.lit("unknown"))
    return assets.groupBy(kind.alias("content_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("needs_extraction").alias("pending")
    ).orderBy(F.desc("n"), "content_type")


def with_bars(counts: DataFrame, width: int = 28) -> DataFrame:
    """Add a text bar relative to the largest count."""
    peak = counts.agg(F.max("n")).scalar()
    return counts.withColumn("bar", T.bar(F.col("n"), peak, width))
