"""Byte-level BPE as a tree reduction over a text, and decoding up the same tree.

A text is halved until a part is short, parts are encoded on their own, and neighbours are joined
by encoding a window over their common boundary anew. A window ends at sync points: places where a
piece of the split pattern ends whatever stands further left or right. Encoding never crosses such a
place, so tokens outside the window are final. The window grows until it has a sync point on either
side, at worst over both parts. Joining is associative; the empty text is its neutral element.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import id_type, map_rows, texts

LEAF = 1024
WINDOW = 64
#: A character that no pattern piece joins to the white space after it, then that white space; and a
#: letter or digit before punctuation. No piece of the split pattern covers either boundary, and none
#: of its choices before the boundary depends on more than the one character after it.
_SYNC = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<=[\p{L}\p{N}])(?=[,.;:!?])")


class Ranks:
    """A rank file as an encoder that tasks load once per process."""

    _loaded: dict[str, Ranks] = {}

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.encoder = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str) -> Ranks:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def leaf(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)


def encode(ranks: Ranks, text: str, leaf: int = LEAF) -> list[int]:
    """Token ids of ``text``: halves are encoded recursively, then joined at their boundary."""
    if len(text) <= leaf:
        return ranks.leaf(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return join(ranks, left, encode(ranks, left, leaf), right, encode(ranks, right, leaf))


def join(ranks: Ranks, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """Ids of ``left + right`` from the ids of both, encoding only a window over the boundary."""
    start = _last_sync(left)
    stop = _first_sync(right)
    window = ranks.leaf(left[start:] + right[:stop])
    cut = len(left_ids) - _tokens(ranks, reversed(left_ids), len(left[start:].encode("utf-8")))
    skip = _tokens(ranks, right_ids, len(right[:stop].encode("utf-8")))
    return left_ids[:cut] + window + right_ids[skip:]


def _last_sync(left: str) -> int:
    """Start of the last piece of ``left`` that is final on its left side, 0 if there is none."""
    size = WINDOW
    while True:
        begin = max(0, len(left) - size)
        found = [m.start() for m in _SYNC.finditer(left, max(0, begin - 1)) if begin <= m.start() > 0]
        if found or begin == 0:
            return found[-1] if found else 0
        size *= 2


def _first_sync(right: str) -> int:
    """End of the first stretch of ``right`` after which its own encoding is final."""
    found = _SYNC.search(right)
    return found.start() if found and found.start() > 0 else len(right)


def _tokens(ranks: Ranks, ids: Iterable[int], size: int) -> int:
    """How many of ``ids``, from the front, make up ``size`` bytes."""
    count = 0
    for token in ids:
        if size <= 0:
            break
        size -= ranks.lengths[token]
        count += 1
    if size:
        raise ValueError("a sync point is not a token boundary")
    return count


def decode(ranks: Ranks, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``; decoding is a homomorphism, so halves are simply concatenated."""
    if len(ids) <= leaf:
        return ranks.encoder.decode_bytes(ids)
    middle = len(ids) // 2
    return decode(ranks, ids[:middle], leaf) + decode(ranks, ids[middle:], leaf)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """``(id, ids)``: token ids of every whole text; null and empty texts have none.

    ``path`` is the rank file, found under the same path on every machine. A narrow step: rows keep
    their place, repeated rows and null ids included.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        ranks = Ranks.load(path)
        for key, text in rows:
            yield key, encode(ranks, text or "", leaf)

    return map_rows(texts(docs, id_col, text_col), run, f"id {id_type(docs, id_col)}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, data)``: the bytes of every id list; null lists decode to nothing."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        ranks = Ranks.load(path)
        for key, ids in rows:
            yield key, decode(ranks, ids or [])

    source = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    return map_rows(source, run, f"id {id_type(tokens, id_col)}, data binary")


def round_trips(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoding every text and decoding it again.

    Both digests come out of one pass, so that ids need not travel: ids count as little-endian
    unsigned 32-bit integers. A null text counts as an empty one.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        ranks = Ranks.load(path)
        for key, text in rows:
            ids = encode(ranks, text or "", leaf)
            packed = np.array(ids, dtype="<u4").tobytes()
            yield key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode(ranks, ids)).hexdigest()

    schema = f"id {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(texts(docs, id_col, text_col), run, schema)
