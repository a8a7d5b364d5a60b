"""SimHash near-duplicates: fingerprints, a grid range join on segment bit counts, and groups.

A fingerprint is cut into two-bit segments; the vector of their bit counts is its embedding. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a
range join under it loses no link. The grid of that join is made of blocks of segments: if two
embeddings differ by at most r in all, one of r//2+1 blocks differs by at most 1. Each fingerprint
stands in its own cell per block, and looks for partners there and in the cells one step up.

A few bits of 64 mean nearly equal texts. Documents that are merely similar differ in so many bits that no
lower bound prunes; `similar_documents` finds them by joins on their rarest shingles, without loss, and
compares the whole sets of shingles afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scope, materialise, scratch
from .common import id_type, map_rows, texts
from .components import connected_components
from .words import mix, rolling, word_hashes

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_RUN = 1 << 18
_LOW_BITS = 0x5555555555555555


def simhash(text: str | None, shingle: int) -> int:
    """Majority vote of the shingle hashes, bit by bit; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _RUN):
        spans = zip(starts[at : at + _RUN], stops[at : at + _RUN])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        for byte, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            counts[8 * byte : 8 * byte + 8] += np.bincount(column, minlength=256) @ _BITS
    value = sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(starts)))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: a signed 64-bit SimHash of every whole text.

    A-Z are lower-cased; shingles are runs of ``shingle`` words with repeats counted; fewer words make
    one shingle; a null or blank text has fingerprint 0. Null ids stay null.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, simhash(text, shingle)

    return map_rows(texts(docs, id_col, text_col), run, f"id {id_type(docs, id_col)}, fingerprint long")


def segment_counts(fingerprint: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each written in unary (00, 01, 11).

    In this form the Manhattan distance of two count vectors is the number of differing bits.
    """
    high = F.shiftrightunsigned(fingerprint, 1)
    some = fingerprint.bitwiseOR(high).bitwiseAND(F.lit(_LOW_BITS))
    full = fingerprint.bitwiseAND(high).bitwiseAND(F.lit(_LOW_BITS))
    return some.bitwiseOR(F.shiftleft(full, 1))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of each block of whole segments."""
    n = radius // 2 + 1
    edges = [2 * (32 * i // n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)`` with a < b: all pairs of distinct fingerprints that differ in at most ``radius`` bits.

    ``distinct`` has one row per fingerprint, so copies are never paired with each other; a fingerprint
    has at most 43,744 others within 3 bits, whatever the input. Both distances are tested inside the
    join, so only true links leave it.
    """
    counts = distinct.select("fingerprint", segment_counts(F.col("fingerprint")).alias("counts"))
    cells, probes = [], []
    for number, (first, bits) in enumerate(_blocks(radius)):
        key = F.shiftrightunsigned("counts", first).bitwiseAND(F.lit((1 << bits) - 1) if bits < 64 else F.lit(-1))
        own = F.struct(F.lit(number).alias("block"), key.alias("cell"))
        cells.append(own)
        probes.append(F.struct(F.lit(number).alias("block"), key.alias("cell"), F.lit(False).alias("up")))
        for bit in range(0, bits, 2):
            low, high = F.lit(1 << bit), F.lit((2 << bit) - (1 << 64) if bit == 62 else 2 << bit)
            step = F.when(key.bitwiseAND(low) == 0, key.bitwiseOR(low)).when(key.bitwiseAND(high) == 0, key.bitwiseOR(high))
            probes.append(F.struct(F.lit(number).alias("block"), step.alias("cell"), F.lit(True).alias("up")))
    base = counts.select(F.inline(F.array(*cells)), F.col("fingerprint").alias("y"), F.col("counts").alias("cy"))
    probe = counts.select(F.inline(F.array(*probes)), F.col("fingerprint").alias("x"), F.col("counts").alias("cx"))
    probe = probe.filter("cell is not null")
    near = (F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= radius) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    on = (probe.block == base.block) & (probe.cell == base.cell) & (F.col("up") | (F.col("x") < F.col("y"))) & near
    return probe.join(base, on).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``.

    Two fingerprints link if they differ in at most ``radius`` bits; ``component_id`` is the smallest
    id reachable over links. Equal fingerprints are one node, so copies cost nothing beyond their own
    row. Repeated rows and null ids each keep a row (a null id never names a component unless it is
    alone); an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "nodes")
    roots = connected_components(links(nodes, radius))
    grouped = roots.join(nodes, roots.node == nodes.fingerprint).select("node", "root", "first")
    named = grouped.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = materialise(grouped.join(named, "root").select(F.col("node").alias("fingerprint"), "lowest"), "components")
    named = nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("lowest", "first").alias("component_id"))
    return prints.join(named, "fingerprint").select("id", "fingerprint", "component_id")


SIMHASH_SHINGLE = 3
SHINGLE_BASE = 0xC2B2AE3D27D4EB4F
BANDS, BAND = 12, 3
SAMPLE, HOT = 64, 1 << 16
#: One in so many members of a set must stand in the prefixes of both, beyond the first.
SHARED = 10
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words make one shingle, no words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    return np.unique(rolling(words, min(shingle, len(words)), SHINGLE_BASE)) if len(words) else np.empty(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a whole set; zero for the empty set."""
    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        total = mix(hashes + np.uint64(_GOLDEN)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total])).view(np.int64)[0])


def min_cells(hashes: np.ndarray) -> list[int]:
    """Keys of bands of minima, each over a share of the set; similar sets are likely to have one in common."""
    lowest = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    np.minimum.at(lowest, (hashes % np.uint64(BANDS * BAND)).astype(np.int64), hashes)
    with np.errstate(over="ignore"):
        keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLDEN)
        for column in lowest.reshape(BANDS, BAND).T:
            keys = mix(keys + column)
    return keys.view(np.int64).tolist()


def shared_least(n: int) -> int:
    """How many of the first members two similar sets must share, for the set of ``n`` (the smaller demand counts)."""
    return 1 + n // SHARED


def prefix_length(n: int, similarity: Fraction) -> int:
    """Two sets at this similarity share ``shared_least`` of so many first members of either, in any common order.

    A set of ``n`` has at most ``n - similarity * n`` members that the other lacks, so among this many first
    members stand the first ``shared_least`` common ones, and they stand in the other's first members too.
    """
    return n - math.ceil(similarity * n) + shared_least(n) if n else 0


def _filter(wanted: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of signed 64-bit values that accepts all of ``wanted`` and few others (16 bits of a map per value)."""
    bits = max(1 << 15, 16 * wanted.count())
    place = F.pmod(F.col(column), F.lit(bits)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
    whole = np.zeros(bits // 8 + (1 << 13), np.uint8)
    for row in maps.collect():
        whole[4096 * (row.number - 1) : 4096 * row.number] = np.frombuffer(row.map, np.uint8)

    def accepts(values: np.ndarray) -> np.ndarray:
        at = values % bits
        return (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return accepts


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose shingle sets have at least this Jaccard similarity.

    Only sets that stand in a pair leave the texts, each once.
    """
    pairs = materialise(pairs, "pairs")
    accepts = _filter(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    above, below = similarity.numerator, similarity.denominator

    def sets(rows: Iterable[tuple]) -> Iterator[tuple]:
        seen: set[int] = set()
        for (text,) in rows:
            hashes = shingle_set(text, shingle)
            node = set_key(hashes)
            if node not in seen and accepts(np.array([node]))[0]:
                seen.add(node)
                yield node, hashes.tobytes()
                if len(seen) > 1 << 18:
                    seen.clear()

    def compare(rows: Iterable[tuple]) -> Iterator[tuple]:
        for a, b, left, right in rows:
            one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            if below * common >= above * (len(one) + len(two) - common):
                yield a, b

    with scratch() as scope:
        found = map_rows(docs.select("text"), sets, "node long, hashes binary")
        found = materialise(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
        a, b = found.select(F.col("node").alias("a"), F.col("hashes").alias("left")), found.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
        return scope.keep(map_rows(pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right"), compare, "a long, b long"), "similar")


def _prefixes(docs: DataFrame, hot: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """``(node, n, prefix)``: the rarest shingles of every distinct set, as many as the prefix rule needs.

    ``hot`` gives the shingles (``shingle``, ``n``) that stand last in the order; what it lacks only costs time.
    """
    known = sorted((r.shingle % (1 << 64), r.n) for r in hot.collect())
    keys, counts = np.array([k for k, _ in known], np.uint64), np.array([n for _, n in known], np.int64)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            hashes = shingle_set(text, shingle)
            if not len(hashes):
                continue
            size = prefix_length(len(hashes), similarity)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                rarest = hashes[np.lexsort((hashes, np.where(keys[at] == hashes, counts[at], 0)))[:size]]
            else:
                rarest = hashes[:size]
            yield set_key(hashes), len(hashes), rarest.view(np.int64).tolist()

    found = map_rows(docs.select("text"), run, "node long, n long, prefix array<long>")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _candidates(prefixes: DataFrame, similarity: Fraction) -> DataFrame:
    """``(a, b)``: all pairs of different ``part`` that the prefix rule cannot rule out.

    Similar sets share ``similarity / (1 + similarity)`` of both sizes, and from their first common shingle on both
    must have room for that many. The join tests this where two sets meet, so it only makes pairs at what may be their
    first common shingle: copies with too many changes of one text, which stand far down their order, make none. Shingles
    whose sets all stand in one part take no part in it. Then the pair's prefixes must have enough in common.
    """
    above, below = similarity.numerator, similarity.denominator
    first = F.col("n") - F.ceil(F.col("n") * above / below) + 1  # places where the first common shingle may stand
    posts = prefixes.select("part", F.explode(F.slice("prefix", F.lit(1), first.cast("int"))).alias("shingle"))
    shared = posts.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("shingle")
    shared = materialise(shared, "shared")
    accepts = _filter(shared, "shingle")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for node, part, n, prefix in rows:
            values = np.array(prefix[: n - math.ceil(similarity * n) + 1], np.int64)
            for at in np.flatnonzero(accepts(values)).tolist():
                yield node, part, n, at, prefix[at]

    posts = map_rows(prefixes.select("node", "part", "n", "prefix"), run, "node long, part long, n long, at long, shingle long")
    posts = materialise(posts, "posts")
    x, y = posts.alias("x"), posts.alias("y")
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (above + below) >= (F.col("x.n") + F.col("y.n")) * above
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") < F.col("y.part")) & room
    met = materialise(x.join(y, on).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct(), "met")
    left = prefixes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("prefix").alias("px"))
    right = prefixes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("prefix").alias("py"))
    # of a prefix all are shared but as many as the whole set may lack
    overlap = F.ceil((F.col("nx") + F.col("ny")) * above / (above + below))
    spare = [F.floor(F.col(n) / SHARED) + 1 - F.ceil(F.col(n) * above / below) for n in ("nx", "ny")]  # prefix less whole
    both = met.join(left, "x").join(right, "y").filter(F.size(F.array_intersect("px", "py")) >= overlap + F.least(*spare))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, component_id)`` per row of ``docs``: groups linked by similar sets of word shingles. Repeated rows share
    their set's group; an empty table gives an empty one.

    Two texts link if the Jaccard similarity of their sets is at least ``similarity``, counted on the sets
    themselves (64-bit hashes of shingles); links are transitive. No pair is lost: a set's rarest shingles
    are joined, as many as make sure that a similar set has one of them too. Equal sets are one
    node. Before that, sets whose SimHash fingerprints differ in at most 3 bits (the grid join of `links`) and
    sets that share a band of minima with the band's first set are compared, so a large group of near copies
    is one part by few pairs, and the join only looks for pairs of different parts. Blank and null texts form one group; null ids name a group only if there is no other.
    """
    least = Fraction(str(similarity))
    source = texts(docs, id_col, text_col)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            hashes = shingle_set(text, shingle)
            node = set_key(hashes)
            sample = hashes.view(np.int64).tolist() if node % SAMPLE == 0 else None
            yield key, node, len(hashes), simhash(text, SIMHASH_SHINGLE), min_cells(hashes) if len(hashes) else [], sample

    schema = f"id {id_type(docs, id_col)}, node long, n long, fingerprint long, cells array<long>, sample array<long>"
    with scratch() as scope:
        return scope.keep(_grouped(source, materialise(map_rows(source, run, schema), "rows"), shingle, least, scope), "similar-documents")


def _near_pairs(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: sets whose fingerprints are within ``radius`` bits, by the grid join; equal fingerprints meet their first set."""
    prints = materialise(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.select("node", "fingerprint").join(prints, "fingerprint").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(prints.select("fingerprint"), radius)
    a, b = (prints.select(F.col("fingerprint").alias(c), F.col("first").alias(f"of_{c}")) for c in ("a", "b"))
    found = near.join(a, "a").join(b, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return found.union(same)


def _grouped(source: DataFrame, rows: DataFrame, shingle: int, least: Fraction, scope: Scope) -> DataFrame:
    """Every row's group from its node, its minima and the samples; ``scope`` owns what is written on the way."""
    # sets are equal whatever the order of their shingles, so of a set's fingerprints one stands for it
    kept = [F.min("id").alias("first"), F.min("fingerprint").alias("fingerprint"), F.first("n").alias("n"), F.first("cells").alias("cells")]
    nodes = materialise(rows.groupBy("node").agg(*kept), "nodes")
    cells = materialise(nodes.select("node", "n", F.explode("cells").alias("cell")), "cells")
    stars = cells.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("star"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = cells.join(stars.select("cell", "star"), "cell").filter("node <> star.node")
    sized = F.least("n", "star.n") * least.denominator >= F.greatest("n", "star.n") * least.numerator
    pairs = met.filter(sized).select(F.col("star.node").alias("a"), F.col("node").alias("b"))
    links_ = _verified(source, pairs.union(_near_pairs(nodes)).distinct(), shingle, least)
    scope.drop(cells)

    parts = connected_components(links_)
    sampled = rows.filter("sample is not null").groupBy("node").agg(F.first("sample").alias("sample"))
    hot = sampled.select(F.explode("sample").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    hot = hot.orderBy(F.desc("n"), "shingle").limit(HOT)
    prefixes = _prefixes(source, hot, shingle, least).join(parts.withColumnRenamed("root", "part"), "node", "left")
    prefixes = materialise(prefixes.select("node", "n", F.coalesce("part", "node").alias("part"), "prefix"), "prefixes")
    links_ = links_.union(_verified(source, _candidates(prefixes, least), shingle, least))

    grouped = connected_components(links_).join(nodes.select("node", "first"), "node")
    named = grouped.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = grouped.join(named, "root").select("node", "lowest")
    named = nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("lowest", "first").alias("component_id"))
    return rows.select("id", "node").join(named, "node").select("id", "component_id")
