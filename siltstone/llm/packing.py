"""Best-fit packing planned on a histogram of lengths.

Documents become token ids plus an end mark; only longer ones are cut. The plan needs nothing but how
many pieces there are of each length (at most ``capacity`` numbers): best-fit decreasing runs over these
counts, filling many equal sequences at once. Every run of equal placements is one row of the plan, and
pieces take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..operators.ranks import ordinals
from ..session import materialise
from .common import id_type, map_rows, texts

CAPACITY = 4096
END_ID = 1
KNOWN_CHUNKS = 1 << 18
PLAN_SCHEMA = "length int, first_rank long, last_rank long, per_sequence long, first_sequence long, first_offset long"
_PLAIN = re.compile("[ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85   -     　]")
#: Composed Latin letters, then punctuation: chunks that normalise to their lower case and split in two.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class ChunkTokens:
    """Token ids of texts, as packed little-endian unsigned 32-bit integers.

    The tokenizer's splits never span white space and it drops white space, so a text's ids are those
    of its white-space-separated chunks in order. Ids of up to ``KNOWN_CHUNKS`` chunks are remembered.
    Simple chunks are merged by the same vocabulary as ranks with a blank for the word end, which costs
    a fraction of the general tokenizer's time; all others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        letters = {c: i for i, c in byte_letters().items()}
        ranks = {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if token not in special:
                word = token.removesuffix("</w>")
                ranks[bytes(letters[c] for c in word) + b" " * (word != token)] = rank
        ranks[b" "] = len(ranks) + len(special)  # never left alone: a word end joins its last byte first
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, batch: list[str]) -> list[bytes]:
        parts = [(_PLAIN.split(t) if _OTHER_SPACE.search(t) else t.split()) if t else [] for t in batch]
        if len(self.known) > KNOWN_CHUNKS:
            self.known.clear()
        merge, known, other = self.merger.encode_ordinary, self.known, []
        for chunk in set().union(*parts) - known.keys():
            simple = _SIMPLE.fullmatch(chunk)
            if simple:
                word, mark = simple.groups()
                known[chunk] = array("I", merge(f"{word.lower()} {mark} " if mark else f"{word.lower()} ")).tobytes()
            else:
                other.append(chunk)
        for chunk, made in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            known[chunk] = array("I", made.ids).tobytes()
        look = known.__getitem__
        return [b"".join(map(look, p)) for p in parts]


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, twin, piece, start, length, ids_crc32)``: every document's ids cut into pieces.

    A null or empty text has the end mark alone. ``twin`` numbers the rows of a task, so that repeated
    rows stay apart.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        encode = ChunkTokens(path)
        for batch in _batches(rows):
            for (key, _, twin), ids in zip(batch, encode([text or "" for _, text, _ in batch])):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    yield key, twin, number, at // 4, len(part) // 4, zlib.crc32(part)

    schema = f"id {id_type(docs, id_col)}, twin long, piece int, start long, length int, ids_crc32 long"
    return map_rows(texts(docs, id_col, text_col, F.monotonically_increasing_id().alias("twin")), run, schema)


def _batches(rows: Iterable[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += len(row[1] or "")
        if held > size or len(batch) >= 4096:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: rows of `PLAN_SCHEMA`.

    Sequences with equal contents are kept as ranges of numbers under their free space. A length goes to
    the range with the least free space that still fits, as often per sequence as fits, until its count
    is used up; a range only partly needed is split, so there are few more ranges than lengths. Both
    the input and the work are bounded by ``capacity``, not by the data.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    rows, used = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            heapq.heappush(free[space], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 1
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = heapq.heappop(free[space])
                if not free[space]:
                    del free[space], spaces[at]
            else:
                each = capacity // length
                space, first, n = capacity, used, -(-left // each)
                used += n
            each = min(space // length, left)
            full = min(n, left // each)
            put(space, first + full, n - full)
            rows.append((length, rank, rank + full * each - 1, each, first, capacity - space))
            put(space - each * length, first, full)
            rank += full * each
            left -= full * each
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document.

    Pieces of one sequence follow each other without gaps from offset 0. An empty table packs to an
    empty result. Texts stay in their tasks; only slim piece rows are ranked and joined.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), PLAN_SCHEMA)
    unique = cut.withColumn("row", F.concat_ws("-", "twin", "piece"))
    ranked = ordinals(unique, ["length"], [], "row", name="rank").alias("r")
    inside = (F.col("r.length") == F.col("s.length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    step = F.col("rank") - F.col("first_rank")
    return ranked.join(slots.alias("s"), inside).select(
        "id", "piece", "start", F.col("r.length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (step % F.col("per_sequence")) * F.col("r.length")).cast("long").alias("offset"),
    )
