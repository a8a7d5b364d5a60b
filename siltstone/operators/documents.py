"""Assembling document rows from extracted pages and from linked assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..schemas import DOCUMENT_FIELDS
from .state import content_hash, document_id


def _header(name: str) -> Column:
    """A response header, its name in lower case or as given."""
    return F.coalesce(F.try_element_at("headers", F.lit(name.lower())), F.try_element_at("headers", F.lit(name)))


def first_filled(*parts: Column) -> Column:
    """First part that is neither NULL nor '', else ''."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def as_documents(df: DataFrame) -> DataFrame:
    """Project onto the document schema; columns a source lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in DOCUMENT_FIELDS
        ]
    )


def page_documents(pages: DataFrame) -> DataFrame:
    """Web-page documents.

    ``pages`` holds the extracted fields plus ``requested_url, url, headers, sitemap_lastmod,
    http_status, content_type, crawled_at, depth, js_rendered``.
    """
    digest = content_hash("text")
    modified = F.coalesce(_header("Last-Modified"), F.lit(""))
    return as_documents(
        pages.withColumn("content_hash", digest)
        .withColumn("id", document_id("content_hash"))
        .withColumn("canonical_url", first_filled(F.col("canonical_url"), F.col("url")))
        .withColumn("source_type", F.lit("web_page"))
        .withColumn("content_type", first_filled(F.col("content_type"), F.lit("text/html")))
        .withColumn("modified_at", first_filled(F.col("modified_at"), modified, F.col("sitemap_lastmod")))
        .withColumn("sitemap_lastmod", F.coalesce("sitemap_lastmod", F.lit("")))
    )


def asset_text(body: Column | str, content_type: Column | str, url: Column | str, pdf_text: Column | None = None) -> Column:
    """Text of a linked document: decoded when it is text, from ``pdf_text`` when it is a PDF."""
    body, content_type = (F.col(c) if isinstance(c, str) else c for c in (body, content_type))
    extension = U.url_extension(url)
    is_text = content_type.startswith("text/") | extension.isin(".txt", ".csv")
    decoded = F.regexp_replace(F.make_valid_utf8(body.cast("string")), r"(?U)^\s+|\s+$", "")
    is_pdf = (content_type == "application/pdf") | (extension == ".pdf")
    extracted = pdf_text if pdf_text is not None else F.lit("")
    return F.when(is_text, decoded).when(is_pdf, F.coalesce(extracted, F.lit(""))).otherwise("")


def asset_documents(assets: DataFrame, saved_under: str | None = None) -> DataFrame:
    """Linked-document rows from ``requested_url, url, content_type, text, headers, ...``.

    Assets have no duplicate check; without text the URL stands in for the hash.
    """
    digest = content_hash(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("url")))
    last_segment = F.regexp_extract(F.col("requested_url"), r"([^/]*)/*$", 1)
    path = F.concat(F.lit(f"{saved_under}/"), U.asset_file_name("url")) if saved_under else F.lit("")
    return as_documents(
        assets.withColumn("content_hash", digest)
        .withColumn("id", document_id("content_hash"))
        .withColumn("canonical_url", F.col("url"))
        .withColumn("source_type", F.lit("linked_document"))
        .withColumn("title", last_segment)
        .withColumn("word_count", T.word_count("text"))
        .withColumn("local_path", path)
        .withColumn("modified_at", F.coalesce(_header("Last-Modified"), F.lit("")))
        .withColumn("needs_extraction", F.col("text") == "")
    )
