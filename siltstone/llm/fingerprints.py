"""SimHash document fingerprints, and permuted block tables that find all within a Hamming radius.

Terms are pairs of neighbouring lower-cased words (single words where there is no pair), weighted by
1 + log of their count; every term's hash bits vote with that weight, for or against, and the sign of
each sum is the fingerprint's bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import id_type, map_rows, texts
from .words import mix, word_hashes

BITS = 256
_NEXT = np.uint64(0x9FB21C651E98DF25)


def fingerprint(text: str | None, bits: int = BITS) -> bytes:
    """``bits`` (a multiple of 64) sign bits; all zero for a text without words."""
    words = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    if not len(words):
        return bytes(bits // 8)
    with np.errstate(over="ignore"):
        terms = mix(words[:-1] * _NEXT + words[1:]) if len(words) > 1 else words
        terms, counts = np.unique(terms, return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        sums = np.zeros(bits, np.float64)
        for at in range(0, len(terms), 1 << 15):
            part, weight = terms[at : at + (1 << 15)], weights[at : at + (1 << 15)]
            for word in range(bits // 64):
                drawn = mix(part + np.uint64((word * 0x9E3779B97F4A7C15) % (1 << 64)))
                votes = np.unpackbits(drawn.view(np.uint8).reshape(-1, 8), axis=1)
                sums[64 * word : 64 * word + 64] += weight @ votes.astype(np.float32)
    return np.packbits(2 * sums > float(weights.sum(dtype=np.float64))).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def document_fingerprints(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``, binary, for every whole text; null, empty and blank texts have all bits zero."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, fingerprint(text, bits)

    return map_rows(texts(docs, id_col, text_col), run, f"id {id_type(docs, id_col)}, fingerprint binary")


def within_radius(queries: DataFrame, base: DataFrame, radius: int, bits: int, blocks: int) -> DataFrame:
    """``(query, match, distance)``: for every query fingerprint all base fingerprints within ``radius`` bits.

    Both inputs have a column ``fingerprint``; each distinct fingerprint is searched and found once, so
    copies make no pairs. A fingerprint is cut into ``blocks`` whole-byte blocks; if two differ in at
    most ``radius`` bits, at least ``blocks - radius`` blocks are equal. There is one table per choice of
    so many blocks, keyed by them (the permutation that brings them to the front); a join per table
    key finds candidates, which are then compared exactly.
    """
    if not radius < blocks <= bits // 8:
        raise ValueError("more blocks than the radius are needed, and a block has a byte at least")
    size = bits // 8
    edges = [size * i // blocks for i in range(blocks + 1)]
    parts = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(edges, edges[1:])]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.struct(F.lit(n).alias("table"), F.concat(*[parts[i] for i in c]).alias("key")) for n, c in enumerate(choices)])

    def tables(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("fingerprint").dropna().distinct().select(F.inline(keys), F.col("fingerprint").alias(name))

    found = tables(queries, "query").join(tables(base, "match"), ["table", "key"])
    distance = sum((F.bit_count(_word(F.col("query"), i).bitwiseXOR(_word(F.col("match"), i))) for i in range(bits // 64)), F.lit(0))
    return found.select("query", "match", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()


def _word(value: Column, number: int) -> Column:
    """Eight bytes of a fingerprint as a signed integer."""
    top = F.conv(F.hex(F.substring(value, 8 * number + 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(value, 8 * number + 5, 4)), 16, 10).cast("long")
    return F.shiftleft(top, 32).bitwiseOR(low)


def _ranges(ids: DataFrame, parts: int) -> list:
    """Ids that cut the table into about equal ranges (numbers only)."""
    found = ids.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    return sorted(set(found))


def edited_likeness(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` per row of ``docs``.

    The edited text has its last half (rounded down) replaced by as many leading characters of the
    next document, in ascending id (then text) order, null ids first; after the last comes the first. Ids are numbers.

    Every text moves once: to the range of its id. Only the first document of a range is sent a second
    time, to the range before it, and a task then walks its range in order, holding two texts.
    """
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)
    order = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _ranges(source.select(order.alias("id")), parts)
    splits = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    ranged = source.withColumn("range", F.size(F.filter(splits, lambda c: c <= order)))
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.min(order).alias("first")).collect()}
    numbers = sorted(firsts)
    before = [(n, numbers[i - 1], float(firsts[n])) for i, n in enumerate(numbers)]
    heads = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(b).alias("to"), F.lit(f).alias("first")) for n, b, f in before]) if before else None
    if heads is None:
        copies = F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("ahead")))
    else:
        head = F.get(F.filter(heads, lambda h: (h.n == F.col("range")) & (h["first"] == order)), 0)
        own = F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("ahead")))
        copies = F.when(head.isNull(), own).otherwise(F.concat(own, F.array(F.struct(head.to.alias("to"), F.lit(True).alias("ahead")))))
    placed = ranged.select("id", "text", F.inline(copies))
    placed = placed.repartition(max(1, len(numbers)), "to").sortWithinPartitions("to", "ahead", "id", "text")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        held = None
        for key, text, _, ahead in rows:
            own = fingerprint(text, bits) if held is not None or not ahead else b""
            if held is not None:
                yield _edited(*held, text or "", own, bits)
            held = None if ahead else (key, text or "", own)

    schema = f"id {id_type(docs, id_col)}, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return map_rows(placed.select("id", "text", "to", "ahead"), run, schema)


def _edited(key: object, text: str, own: bytes, following: str, after: bytes, bits: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = fingerprint(edited, bits)
    return key, len(text), edited, own, changed, likeness(own, changed), likeness(own, after)
