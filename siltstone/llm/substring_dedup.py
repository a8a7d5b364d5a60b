"""Repeated passages: a count-min prefilter over window representatives, then exact groups.

Every window of ``window`` words is represented by the smallest hash among its runs of ``GRAM`` words,
so equal windows have equal representatives at equal offsets, and a text has about one representative
per fourteen words. Count-min sketches of the representatives' positions, built per partition and merged
by addition, never count a window too low; windows whose count is one are dropped there. A second
pass reads only texts with windows left, groups those exactly by two independent 64-bit hashes of the
words, and loses none. Equal word sequences are handled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import map_rows, small_batches, texts
from .words import rolling, word_hashes

GRAM = 8
_GRAM_BASE, _FIRST_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def representatives(grams: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` gram hashes the position of its smallest one, the leftmost on ties."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, width = grams, np.arange(len(grams)), 1
    while width < span:  # doubling: minima over runs of 1, 2, 4, ... and a last overlapping step
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        lower = right < left
        at = np.where(lower, at[step:], at[: len(at) - step])
        best = np.where(lower, right, left)
        width += step
    return at


def sequence_key(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _summaries(source: DataFrame, window: int) -> DataFrame:
    """Per row: the text's hash, the number of words, a key of the word sequence, its representatives."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            words = data.split()
            grams = rolling(word_hashes(data), GRAM, _GRAM_BASE)
            at = np.unique(representatives(grams, window - GRAM + 1))
            yield key, len(words), sequence_key(words), grams[at].view(np.int64).tolist(), at.tolist()

    schema = "text_key long, n_words long, sequence binary, grams array<long>, starts array<int>"
    return map_rows(source.select("text_key", "text"), run, schema)


def sketch(rows: DataFrame, cell: Column) -> DataFrame:
    """Cells of one sketch row that were counted twice or more.

    Each task adds up its own cells before the shuffle; adding the partial sketches merges them. The
    sketch is kept as a table of its filled cells, so it grows with the data and is never collected.
    """
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")


def estimated_repeats(rows: DataFrame) -> DataFrame:
    """Rows ``(number, gram, start)`` whose smallest count over two sketch rows exceeds one.

    The second sketch counts only what passed the first: all occurrences of a repeated gram pass
    together, so its counts are never too low either.
    """
    for cell in (F.shiftright("gram", 32), F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF))):
        keyed = rows.withColumn("cell", cell)
        rows = materialise(keyed.join(sketch(rows, cell), "cell", "left_semi").drop("cell"), "repeats")
    return rows


def _window_keys(docs: DataFrame, window: int) -> DataFrame:
    """Exact keys of the windows that a candidate representative stands for; copies give theirs once a task."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        done: set[int] = set()
        for text, sequence, number, starts in rows:
            data = (text or "").encode("utf-8", "surrogatepass")
            if number in done or sequence_key(data.split()) != sequence:
                continue
            done.add(number)
            hashes = word_hashes(data)
            stands = representatives(rolling(hashes, GRAM, _GRAM_BASE), window - GRAM + 1)
            chosen = np.flatnonzero(np.isin(stands, np.array(starts)))
            first = rolling(hashes, window, _FIRST_BASE)[chosen].view(np.int64).tolist()
            second = rolling(hashes, window, _SECOND_BASE)[chosen].view(np.int64).tolist()
            yield from zip(first, second, [number] * len(first), chosen.tolist())

    return map_rows(docs, run, "first long, second long, number long, at int")


def passages(source: DataFrame, window: int) -> DataFrame:
    """``(text_key, n_words, sequence, whole, starts)``, one row per distinct text of ``source``.

    ``starts`` are the repeated windows of the text (null for none); ``whole`` says that the word
    sequence occurs more than once, so that all its windows are repeated.
    """
    rows = materialise(_summaries(source, window), "summaries")
    one = F.first(F.struct("text_key", "grams", "starts")).alias("one")
    sequences = rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("copies"), one)
    sequences = materialise(sequences.select("sequence", "copies", "one.*", F.monotonically_increasing_id().alias("number")), "sequences")
    flat = sequences.select("number", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("starts").alias("start"))))
    likely = estimated_repeats(flat).groupBy("number").agg(F.collect_set("start").alias("starts"))
    likely = likely.join(sequences.select("number", "text_key", "sequence"), "number")
    again = source.select("text_key", "text").join(likely, "text_key").select("text", "sequence", "number", "starts")
    keys = materialise(_window_keys(again, window), "windows")
    place = F.xxhash64("number", "at")
    shared = keys.groupBy("first", "second").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    shared = materialise(shared.filter("low <> high").select("first", "second"), "shared-windows")
    repeated = keys.join(shared, ["first", "second"], "left_semi").groupBy("number").agg(F.collect_set("at").alias("starts"))
    found = sequences.select("sequence", "copies", "number").join(repeated, "number", "left")
    whole = ((F.col("copies") > 1) & (F.col("n_words") >= window)).alias("whole")
    distinct = rows.select("text_key", "n_words", "sequence").distinct()
    return distinct.join(found, "sequence").select("text_key", "n_words", "sequence", whole, "starts")


def cut(words: list[bytes], starts: Iterable[int], window: int) -> tuple[int, bytes]:
    """How many words the windows at ``starts`` cover, and the other words joined by one space."""
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.array(sorted(starts), dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    gone = np.cumsum(covered)[:-1] > 0
    return int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _cut_column(window: int):
    @F.pandas_udf("n_removed long, kept string")
    def cut_texts(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [
            (0, None) if text is None or at is None else cut(text.encode("utf-8", "surrogatepass").split(), at, window)
            for text, at in zip(texts, starts)
        ]
        return pd.DataFrame([(n, None if k is None else k.decode("utf-8", "surrogatepass")) for n, k in rows], columns=["n_removed", "kept"])

    return cut_texts


def remove_repeats(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``(id, n_words, n_removed, kept, kept_sha256, doc)`` per row of ``docs``.

    A word goes if any window over it has a word sequence that also starts elsewhere, in the same text
    or another; windows are judged on the input, not on what earlier removals leave. ``kept`` is null
    where nothing goes (the text stays as it is), else the kept words joined by one space. Texts of fewer
    than ``window`` words, blank and null texts lose nothing; repeated rows are copies of each other; ids
    are only carried, so null and repeated ids do no harm. ``doc`` is a struct of the ``carry`` columns.
    """
    doc = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    source = texts(docs, id_col, text_col, doc.alias("doc")).withColumn("text_key", F.xxhash64("text"))
    found = materialise(passages(source, window), "passages")
    small_batches(docs.sparkSession)
    rows = source.join(found, "text_key")
    part = F.when(~F.col("whole") & F.col("starts").isNotNull(), F.col("text"))
    rows = rows.withColumn("cut", _cut_column(window)(part, F.col("starts")))
    kept = F.when(F.col("whole"), F.lit("")).otherwise(F.col("cut.kept"))
    return rows.select(
        "id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.col("cut.n_removed")).alias("n_removed"),
        kept.alias("kept"),
        F.coalesce(F.sha2(kept, 256), F.lower(F.hex("sequence"))).alias("kept_sha256"),
        "doc",
    )
