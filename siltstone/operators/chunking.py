"""Structure-aware chunking, one document row in, its chunks out, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.binding import let
from ..schemas import CHUNK

CHUNK_SIZE = 700
OVERLAP = 100


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping word windows; a text that fits stays as it is, a blank one yields none."""
    step = max(1, size - overlap)

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step))
        whole = F.when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
        return F.when(n <= size, whole).otherwise(
            F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))
        )

    return let(T.words(text), cut)


def _group_starts(counts: Column, size: int) -> Column:
    """Greedy packing over token counts: ``array<struct<at,big>>``, one entry per group.

    A section above the budget stands alone (``big``); the others join the open group while
    the sum of their tokens fits. The accumulator holds positions only, never texts.
    """
    empty = F.array().cast("array<struct<at:int,big:boolean>>")
    start = F.struct(empty.alias("groups"), F.lit(0).alias("used"), F.lit(0).alias("i"), F.lit(False).alias("open"))

    def step(acc: Column, tokens: Column) -> Column:
        big = tokens > size
        joins = ~big & acc["open"] & (acc["used"] + tokens <= size)
        opened = F.concat(acc["groups"], F.array(F.struct(acc["i"].alias("at"), big.alias("big"))))
        return F.struct(
            F.when(joins, acc["groups"]).otherwise(opened).alias("groups"),
            F.when(big, F.lit(0)).when(joins, acc["used"] + tokens).otherwise(tokens).alias("used"),
            (acc["i"] + 1).alias("i"),
            (~big).alias("open"),
        )

    return F.aggregate(counts, start, step, lambda acc: acc["groups"])


def _packed(sections: Column, groups: Column, size: int, overlap: int) -> Column:
    """``array<struct<label,content>>`` of all groups, in order."""
    ends = F.concat(F.transform(F.slice(groups, 2, F.size(groups)), lambda g: g["at"]), F.array(F.size(sections)))
    spans = F.zip_with(groups, ends, lambda g, end: F.struct(g["at"].alias("at"), g["big"].alias("big"), end.alias("end")))

    def block(s: Column) -> Column:
        return F.when(s["heading"] != "", F.concat(s["heading"], F.lit("\n"), s["text"])).otherwise(s["text"])

    def chunk(span: Column) -> Column:
        head = F.get(sections, span["at"])
        members = F.slice(sections, span["at"] + 1, span["end"] - span["at"])
        merged = F.struct(
            F.coalesce(F.nullif(head["heading"], F.lit("")), F.lit("Overview")).alias("label"),
            F.array_join(F.transform(members, block), "\n\n").alias("content"),
        )
        split = F.transform(
            windows(head["text"], size, overlap),
            lambda w: F.struct(head["heading"].alias("label"), w.alias("content")),
        )
        return F.when(span["big"], split).otherwise(F.array(merged))

    return F.flatten(F.transform(spans, chunk))


def pack_sections(
    sections: Column | str, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
    count_tokens: Callable[[Column], Column] = T.token_count,
) -> Column:
    """``array<struct<label,content>>``: small sections merged, oversized ones windowed."""
    clean = F.transform(
        F.col(sections) if isinstance(sections, str) else sections,
        lambda s: F.struct(
            F.coalesce(s["heading"], F.lit("")).alias("heading"), F.coalesce(s["text"], F.lit("")).alias("text")
        ),
    )

    def packed(rows: Column) -> Column:
        counts = F.transform(rows, lambda s: count_tokens(s["text"]))
        return let(_group_starts(counts, size), lambda groups: _packed(rows, groups, size, overlap))

    return let(clean, packed)


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
    count_tokens: Callable[[Column], Column] = T.token_count,
) -> DataFrame:
    """Chunks of every document; texts without sections are windowed under their title.

    Blank parts are dropped but keep their index. Narrow: the plan has no exchange.
    """
    parent = F.coalesce(F.nullif("id", F.lit("")), F.substring(F.coalesce("content_hash", F.lit("")), 1, 32))
    plain = F.transform(
        windows(F.coalesce("text", F.lit("")), size, overlap),
        lambda w: F.struct(F.coalesce("title", F.lit("")).alias("label"), w.alias("content")),
    )
    structured = F.coalesce(F.size("sections"), F.lit(0)) > 0
    parts = F.when(structured, pack_sections("sections", size, overlap, count_tokens)).otherwise(plain)
    rest = [c for c in docs.columns if c not in ("sections", "text", "id", "content_hash")]
    rows = docs.select(*rest, parent.alias("parent_id"), F.posexplode(parts).alias("chunk_index", "_part"))
    content = F.col("_part.content")

    def default(name: str, fallback: Column = F.lit("")) -> Column:
        return F.coalesce(F.col(name), fallback).alias(name)

    return rows.filter(content.rlike(r"(?U)\S")).select(
        F.concat_ws("_", "parent_id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "parent_id", "chunk_index", default("url"),
        F.coalesce(F.nullif("canonical_url", F.lit("")), "url", F.lit("")).alias("canonical_url"),
        default("title"), F.col("_part.label").alias("section"), content.alias("content"),
        count_tokens(content).alias("token_count"), default("source_type", F.lit("web_page")),
        default("content_type"), default("published_at"), default("modified_at"), default("crawled_at"),
        default("breadcrumbs", F.array().cast("array<string>")),
    ).select(*CHUNK.names)


def chunk_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents by path taken, chunks, and token spread; a single aggregate."""
    structured = F.coalesce(F.size("sections"), F.lit(0)) > 0
    rows = docs.select(F.lit("document").alias("kind"), structured.alias("structured")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "token_count", "source_type"), allowMissingColumns=True
    )
    is_chunk, is_document = F.col("kind") == "chunk", F.col("kind") == "document"
    return rows.agg(
        F.count_if(is_document).alias("documents"),
        F.count_if(is_document & F.col("structured")).alias("structured"),
        F.count_if(is_document & ~F.col("structured")).alias("fallback"),
        F.count_if(is_chunk).alias("chunks"),
        F.median("token_count").alias("median_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.count_if(is_chunk & (F.col("source_type") == "web_page")).alias("from_pages"),
        F.count_if(is_chunk & (F.col("source_type") == "linked_document")).alias("from_assets"),
    )
