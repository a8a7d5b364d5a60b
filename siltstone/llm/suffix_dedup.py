"""Repeated byte strings found by bucket-pointer refinement over the suffixes of all texts.

A suffix array of every byte would be many times the corpus, so suffixes start at *anchors* only: of the
grams of ``q`` bytes in a window, the one with the smallest hash (the leftmost of equals). Equal windows
choose equal anchors at equal distance, so nothing is lost, and prose has one anchor per some 170 bytes.

Anchors are bucketed by their gram. Every bucket is then refined by the identifiers of the pieces at later
offsets, and, as a window reaches to both sides of its anchor, at earlier ones: the new bucket of a suffix is
named by (bucket so far, piece), and that name is what the next round sorts on. A round narrows the
distances from window start to anchor that a bucket speaks for (343, 49, 7, 1 of them for 400 bytes), so its
common string grows until it is the whole window. Buckets with one member go, as no window in them can
repeat. Members whose whole reach is found again with the same reach are accepted at once; the rest, near the
ends of repeated passages, goes to the next round, with one of each group of accepted members as a partner.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import split_by_match
from ..session import materialise, scratch
from .common import map_rows, small_batches, texts
from .words import mix, powers

FAN = 7
_BASE = 0x8CB92BA72F3D8DD7
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 20
_KEYS = ["k1", "k2"]
_SCATTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def widths(window: int) -> list[int]:
    """How many window starts a bucket speaks for in each round; the first leaves grams of an eighth of a window."""
    rounds = [1]
    while window - rounds[0] * FAN + 1 >= max(1, window // 8):
        rounds.insert(0, rounds[0] * FAN)
    return rounds


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values: the rest of one block, and the beginning of the next."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(data: bytes, window: int, width: int, block: int = _BLOCK) -> Iterator[tuple[int, int, int]]:
    """``(at, low, high)``: an anchor, and the distances to it from the window starts that chose it.

    Long texts go block by block; an anchor of windows on both sides of a cut comes twice, with other distances.
    """
    q = window - width + 1
    inverse = pow(_BASE, -1, 1 << 64)
    for begin in range(0, len(data) - window + 1, block):
        raw = np.frombuffer(data, np.uint8, min(block + window - 1, len(data) - begin), begin)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_SCATTER[raw] * powers(_BASE, len(raw)), out=total[1:])
        grams = mix((total[q:] - total[:-q]) * powers(inverse, len(raw) - q + 1))
        order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(order, width) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:], [len(at)]]) - 1
        chosen = at[first]
        yield from zip((chosen + begin).tolist(), (chosen - last).tolist(), (chosen - first).tolist())


def _names(pieces: list[bytes]) -> list[list[int]]:
    """128-bit names of byte strings as two columns of numbers."""
    joined = b"".join([xxhash.xxh3_128_digest(p) for p in pieces])
    return np.frombuffer(joined, "<i8").reshape(-1, 2).T.tolist()


_MEMBER = "k1 long, k2 long, bucket long, at int, low short, high short, part short, c1 long, c2 long, h1 long, h2 long"


def _members(rows: list[tuple], cores: list[bytes], reaches: list[bytes]) -> Iterator[tuple]:
    return zip(*zip(*rows), *_names(cores), *_names(reaches)) if rows else iter(())


def _first_members(distinct: DataFrame, window: int, width: int) -> DataFrame:
    """Every anchor with the name of its gram and of its whole reach."""
    q = window - width + 1

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for k1, k2, data in rows:
            found, cores, reaches = [], [], []
            for at, low, high in anchors(data, window, width):
                found.append((k1, k2, 0, at, low, high, 0))
                cores.append(data[at : at + q])
                reaches.append(data[at - high : at - low + window])
                if len(found) >= 4096:
                    yield from _members(found, cores, reaches)
                    found, cores, reaches = [], [], []
            yield from _members(found, cores, reaches)

    return map_rows(distinct.filter(F.length("data") >= window).select(*_KEYS, "data"), run, _MEMBER)


def _next_members(undecided: DataFrame, distinct: DataFrame, window: int, wide: int, width: int) -> DataFrame:
    """Undecided members cut into parts of ``width`` distances, named by what their common string gains on either side."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for k1, k2, nodes, data in rows:
            found, cores, reaches = [], [], []
            for node in nodes:
                bucket, at, low, high = node["bucket"], node["at"], node["low"], node["high"]
                begin = low // wide * wide
                for part in range(low // width * width, high + 1, width):
                    lower, higher = max(low, part), min(high, part + width - 1)
                    found.append((k1, k2, bucket, at, lower, higher, part))
                    after = at - begin - wide + 1 + window
                    cores.append(data[at - part : at - begin] + data[after : at - part - width + 1 + window])
                    reaches.append(data[at - higher : at - lower + window] if width > 1 else b"")
                if len(found) >= 4096:
                    yield from _members(found, cores, reaches)
                    found, cores, reaches = [], [], []
            yield from _members(found, cores, reaches)

    node = F.struct("bucket", F.col("at"), F.col("low"), F.col("high"))
    nodes = undecided.groupBy(*_KEYS).agg(F.collect_list(node).alias("nodes"))
    return map_rows(nodes.join(distinct.select(*_KEYS, "data"), _KEYS), run, _MEMBER)


def _again(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Key values with two members or more; ``number`` names the bucket, ``one`` is a member of it."""
    one = F.min(F.struct(*_KEYS, "at")).alias("one")
    counted = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), one).filter("n > 1")
    return materialise(counted.withColumn("number", F.monotonically_increasing_id()), name)


def repeated_spans(distinct: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, start, stop)``: bytes covered by windows that start elsewhere too; spans may overlap.

    ``distinct`` has each text once: ``(k1, k2, data)``, best laid out in buckets of the key.
    """
    rounds = widths(window)
    accepted: list[DataFrame] = []
    with scratch() as scope:
        members = materialise(_first_members(distinct, window, rounds[0]), "members")
        for wide, width in zip(rounds, [*rounds[1:], 0]):
            cores = ["bucket", "part", "c1", "c2"]
            alike, _ = split_by_match(members, _again(members, cores, "cores"), cores)
            alike = alike.select(*_KEYS, F.col("number").alias("bucket"), "at", "low", "high", "h1", "h2")
            span = [F.col("at") - F.col("high"), F.col("at") - F.col("low") + F.lit(window)]
            span = [*_KEYS, span[0].cast("int").alias("start"), span[1].cast("int").alias("stop")]
            if not width:
                accepted.append(materialise(alike.select(*span), "spans"))
                break
            alike = materialise(alike, "alike")
            reach = ["bucket", "low", "high", "h1", "h2"]
            again = _again(alike, reach, "reaches")
            sure, undecided = split_by_match(alike, again, reach)
            accepted.append(materialise(sure.select(*span), "spans"))
            fields = [*_KEYS, "bucket", "at", "low", "high"]
            undecided = materialise(undecided.select(*fields), "undecided")
            partners = again.select("one.*", "bucket", "low", "high").join(undecided.select("bucket").distinct(), "bucket", "left_semi")
            both = undecided.unionByName(partners.select(*fields))
            following = materialise(_next_members(both, distinct, window, wide, width), "members")
            scope.drop(members, alike)
            members = following
        spans = accepted[0]
        for more in accepted[1:]:
            spans = spans.unionByName(more)
        return scope.keep(spans, "repeated-spans")


def runs(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans put together into maximal runs, in order."""
    joined: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            if stop > joined[-1][1]:
                joined[-1] = (joined[-1][0], stop)
        else:
            joined.append((start, stop))
    return joined


def _cut(rows: Iterable[tuple]) -> Iterator[tuple]:
    for k1, k2, spans, data in rows:
        gone = runs((s["start"], s["stop"]) for s in spans)
        edges = [0, *(e for run in gone for e in run), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        yield k1, k2, [{"start": a, "stop": b} for a, b in gone], kept


def remove_repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, text_sha256, spans, kept)`` per row of ``docs``.

    Texts are UTF-8 bytes. A byte goes if any ``window`` bytes over it also start elsewhere, in the same text
    or another; windows are judged on the input and never cross texts. ``spans`` are the maximal removed runs
    and ``kept`` the other bytes; both are null where nothing goes. Null texts count as empty; empty texts and
    those under ``window`` bytes lose nothing; rows that repeat in full are copies of each other and lose
    everything from ``window`` bytes up; null and repeated ids are only carried; further columns are ignored;
    an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    source = texts(docs, id_col, text_col).select("id", text.alias("data"), part(1).alias("k1"), part(16).alias("k2"), digest.alias("text_sha256"))
    with scratch() as scope:
        one = source.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.first("data").alias("data"))
        distinct = materialise(one, "texts", buckets=_KEYS)
        spans = repeated_spans(distinct.select(*_KEYS, "data"), window)
        gathered = spans.groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        single = distinct.filter(F.col("n") == 1).select(*_KEYS, "data")
        cut = map_rows(gathered.join(single, _KEYS), _cut, "k1 long, k2 long, spans array<struct<start:int,stop:int>>, kept binary")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length("data").alias("stop")))
        copies = distinct.filter((F.col("n") > 1) & (F.length("data") >= window))
        copies = copies.select(*_KEYS, whole.alias("spans"), F.lit(b"").alias("kept"), "n")
        changed = materialise(cut.withColumn("n", F.lit(1).cast("long")).unionByName(copies), "changed")
        rows = source.select("id", *_KEYS, F.length("data").cast("long").alias("n_bytes"), "text_sha256")
        met, rest = split_by_match(rows, changed, _KEYS)
        columns = ["id", "n_bytes", "text_sha256", "spans", "kept"]
        result = met.select(*columns).unionByName(rest.select(*columns[:3]), allowMissingColumns=True)
        return scope.keep(result, "kept-bytes")
