"""Phrases whose words stand together far more often than apart, from count streams in prefix and suffix order.

Every word gets a number that follows the order of (language, word), so sorting numbers sorts phrases. One
stream holds each place of the corpus with the two words after it, in prefix order; equal neighbours are added up,
and because a phrase stands directly before its extensions, the same pass counts all orders. What is
frequent enough is laid out twice more: in suffix order, where a phrase follows its own ending, and in prefix order,
where it follows its beginning. Reading along, a row takes the counts of its parts from the rows just
passed and hands its own count back to the phrase it extends. Nothing is looked up by hash.

Streams are range-partitioned by their first word. The rows of a word with more than its share go to several
ranges, and the word's own count goes to each of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import top_k_per
from ..session import materialise, scratch
from .common import map_rows, small_batches

BLOCK = 1 << 20
_CHUNK = 1 << 20
_LETTERS = bytes(range(65, 91))
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_LETTERS + _BREAKS + b"\t", _LETTERS.lower() + b"\n" * len(_BREAKS) + b" ")
#: A word with more than one in so many of all words or rows is split over ranges; fewer than this many can be.
SHARE = 1000
SPREAD = 64


class _Book:
    """Words of one language in one block: numbers in order of appearance, and the running text as numbers."""

    def __init__(self) -> None:
        self.numbers = defaultdict(count().__next__, {})
        self.numbers[b""], self.numbers[b"\n"]  # noqa: B018  numbers 0 (nothing) and 1 (break)
        self.text: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        start = 0
        while start < len(data):
            stop = start + _CHUNK
            if stop < len(data):
                stops = [at for at in (data.find(b" ", stop), data.find(b"\n", stop)) if at >= 0]
                stop = min(stops, default=len(data))
            words = data[start:stop].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.text.append(found[found > 0])
            self.size += len(self.text[-1])
            start = stop
        self.text.append(np.ones(1, np.int32))
        self.size += 1

    def row(self, lang: str) -> tuple:
        """Language, words in byte order, their counts, and the text: 0 for a break, else the word's place from 1."""
        words = list(self.numbers)[2:]
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.zeros(len(words) + 2, np.int32)
        place[np.array(order, int) + 2] = np.arange(1, len(words) + 1)
        text = place[np.concatenate(self.text)]
        counts = np.bincount(text, minlength=len(words) + 1)[1:]
        return lang, [words[i].decode("utf-8", "surrogatepass") for i in order], counts.tolist(), text.astype("<i4").tobytes()


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """The corpus as numbers, some ``block`` words at a time; a document is never cut."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        books: dict[str, _Book] = {}
        held = 0
        for lang, text in rows:
            if not text:
                continue
            book = books.setdefault(lang, _Book())
            held -= book.size
            book.add(text.encode("utf-8", "surrogatepass").translate(_TABLE))
            held += book.size
            while held >= block:
                largest = max(books, key=lambda name: books[name].size)
                full = books.pop(largest)
                held -= full.size
                yield full.row(largest)
        for lang, book in books.items():
            yield book.row(lang)

    found = map_rows(docs, run, "lang string, words array<string>, counts array<long>, text binary")
    return found.withColumn("block", F.monotonically_increasing_id())


def _vocabulary(blocks: DataFrame, least: int, ranges: int) -> DataFrame:
    """Words with ``least`` occurrences or more: ``lang, word, n, id, at, ways``.

    ``id`` grows with (lang, word). ``at`` is the range of a word's rows, cut so that ranges hold about as
    many rows; a word that fills more than one is dealt to ``ways`` ranges.
    """
    words = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ordered = materialise(often.orderBy("lang", "word").withColumn("id", F.monotonically_increasing_id() + 1), "words")
    piece = F.shiftright("id", 33)
    sizes = ordered.groupBy(piece.alias("piece")).agg(F.sum("n").alias("size"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    offsets = sizes.select("piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("piece").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    total = ordered.agg(F.sum("n")).first()[0] or 1
    placed = ordered.withColumn("piece", piece).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "piece")
    at = F.floor((F.col("offset") + F.col("inside")) * F.lit(ranges) / F.lit(total)).cast("int")
    ways = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(ranges) / F.lit(total))).cast("int")
    return materialise(placed.select("lang", "word", "n", "id", at.alias("at"), ways.alias("ways")), "vocabulary")


_PLACES = "part int, split boolean, w1 long, w2 long, w3 long, n int"


def _places(blocks: DataFrame, vocabulary: DataFrame, ranges: int) -> DataFrame:
    """Each place with two frequent words or three in a row, once per block with its count; ``w3`` is 0 at a break."""
    words = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = words.join(vocabulary, ["lang", "word"]).groupBy("block").agg(
        *[F.collect_list(c).alias(c) for c in ("place", "id", "at", "ways")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = np.frombuffer(batch.column(0)[row].as_py(), "<i4")
                place, number, at, ways = (c[row].values.to_numpy() for c in batch.columns[1:])
                yield from _grams(text, place + 1, number, at, ways, ranges)

    return blocks.select("block", "text").join(known, "block").select("text", "place", "id", "at", "ways").mapInArrow(run, _PLACES)


def _grams(text: np.ndarray, place: np.ndarray, number: np.ndarray, at: np.ndarray, ways: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(place)
    number, at, ways = (np.concatenate([[0], v[order]]) for v in (number, at, ways))
    small = np.zeros(max(int(text.max(initial=0)), int(place.max(initial=0))) + 1, np.int64)
    small[place[order]] = np.arange(1, len(place) + 1)  # frequent words keep their order, all else is 0
    run = small[text]
    ahead = np.concatenate([run, [0, 0]])
    first, second, third = ahead[:-2], ahead[1:-1], ahead[2:]
    keep = (first > 0) & (second > 0)
    packed, n = np.unique((first[keep] << 42) | (second[keep] << 21) | third[keep], return_counts=True)
    w1, w2, w3 = packed >> 42, (packed >> 21) & 0x1FFFFF, packed & 0x1FFFFF
    deal = (number[w2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number[w3].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
    part = (at[w1] + (deal % ways[w1].astype(np.uint64)).astype(np.int64)) % ranges
    columns = [part.astype(np.int32), ways[w1] > 1, number[w1], number[w2], number[w3], n.astype(np.int32)]
    for start in range(0, len(n), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in columns], names=["part", "split", "w1", "w2", "w3", "n"])


def _add_up(least: int):
    """Sums of equal neighbours of the sorted stream: phrases of three words, and of two before their extensions.

    Counts of two words may be partial where the first word is split; those pass whatever they are.
    """

    def sums(values: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        return starts, np.add.reduceat(values, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = triple = None  # the last phrase of either order, with its count so far
        for batch in batches:
            split, w1, w2, w3, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(n):
                continue
            rows = []
            n = n.astype(np.int64)
            for keys, last in (([w1, w2], pair), ([w1, w2, w3], triple)):
                starts, total = sums(n, keys)
                found = [(bool(split[s]), *(int(k[s]) for k in keys)) for s in starts[[0, -1]]]
                if last and last[0] == found[0]:
                    total[0] += last[1]
                elif last:
                    rows.append(last)
                if len(keys) == 2:
                    pair = (found[1], int(total[-1]))
                else:
                    triple = (found[1], int(total[-1]))
                done = np.flatnonzero((total[:-1] >= least) | (split[starts[:-1]] & (len(keys) == 2)))
                at = starts[done]
                ends = [k[at] for k in keys] + [np.zeros(len(at), np.int64)] * (3 - len(keys))
                if len(keys) == 3:
                    whole = ends[2] > 0
                    ends, done = [e[whole] for e in ends], done[whole]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ends, total[done])], names=["w1", "w2", "w3", "n"])
            yield closed(rows)
        yield closed([last for last in (pair, triple) if last])

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        kept = [(*(key[1:] + (0,))[:3], n) for key, n in rows if (len(key) == 3 and (n >= least or key[0])) or (len(key) == 4 and key[3] and n >= least)]
        columns = list(zip(*kept)) if kept else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["w1", "w2", "w3", "n"])

    return run


def _ordered(headers: DataFrame, grams: DataFrame, first: Column, second: Column, third: Column, heavy: DataFrame) -> DataFrame:
    """Words and phrases in one stream by (first, second, third); a word with many phrases stands in several ranges."""
    keyed = grams.withColumns({"o1": first, "o2": second, "o3": third})
    hot = F.broadcast(heavy.select(F.col("id").alias("o1"), F.lit(True).alias("hot")))  # fewer than SHARE rows
    keyed = keyed.join(hot, "o1", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("o2", F.lit(SPREAD))).otherwise(0)).drop("hot")
    words = headers.select(F.col("id").alias("o1"), F.lit(0).cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"), "n", "word", "lang")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    words = words.join(hot, "o1", "left").withColumn("salt", F.explode(salts)).drop("hot")
    stream = keyed.withColumn("salt", F.col("salt").cast("int")).unionByName(words, allowMissingColumns=True)
    return stream.repartitionByRange("o1", "salt").sortWithinPartitions("o1", "salt", "o2", "o3")


def _endings(least: int):
    """Along the suffix order: a phrase's last word, counts of its endings, and the largest count of a longer one to its left."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        word = pair = None
        for o1, o2, o3, n, text in _added(rows):
            if not o2:
                word = (o1, n, text)
            elif not o3:
                if pair:
                    yield tuple(pair)
                pair = [o2, o1, 0, n, word[1], 0, word[2], 0] if n >= least else None
            elif n >= least:
                pair[7] = max(pair[7], n)
                yield o3, o2, o1, n, word[1], pair[3], word[2], 0
        if pair:
            yield tuple(pair)

    return run


def _added(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Parts of one phrase's count (from split ranges) become one; a word's own rows, one a salt, stay as they are."""
    last = None
    for row in rows:
        if last and row[1] and row[:3] == last[:3]:
            last = (*last[:3], last[3] + row[3], *last[4:])
            continue
        if last:
            yield last
        last = row
    if last:
        yield last


def weakest_cut(a: int, parts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """``(score, l, r)`` of the lowest-scoring cut, the first of equals; integers of any size."""
    scored = [(1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(parts)]
    score, _, l, r = min(scored)
    return score, l, r


def _beginnings(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Along the prefix order: counts of beginnings and of longer phrases to the right, and with them the scores."""
    word = pair = None

    def candidate(a: int, parts: list[tuple[int, int]], phrase: str, longer: int) -> tuple | None:
        if 100 * longer >= 50 * a:
            return None
        score, l, r = weakest_cut(a, parts)
        return word[2], phrase, a, l, r, score

    for o1, o2, o3, n, text, lang, last, end, ending, longer in rows:
        if not o3 and pair:
            if row := candidate(pair[0], [(word[1], pair[1])], f"{word[0]} {pair[2]}", pair[3]):
                yield row
            pair = None
        if not o2:
            word = (text, n, lang)
        elif not o3:
            pair = [n, end, last, longer]
        else:
            pair[3] = max(pair[3], n)
            yield candidate(n, [(word[1], ending), (pair[0], end)], f"{word[0]} {pair[2]} {last}", 0)
    if pair and (row := candidate(pair[0], [(word[1], pair[1])], f"{word[0]} {pair[2]}", pair[3])):
        yield row


def collocations(
    docs: DataFrame, least: int = 10, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of two and three words of each language.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces, pieces into words at spaces and
    tabs. ``a`` counts the phrase within pieces, overlaps included, and is ``least`` or more; ``l`` and ``r``
    count the two parts of its weakest cut, ``n`` all words of the language, and ``score`` is
    ``floor(1000000 * a * a / (l * r))`` in exact integers. A phrase goes if a longer one with ``least``
    occurrences or more that contains it has half of its count. Order: score, then ``a``, descending, then the
    phrase by bytes; ``top`` limits each language (None: all). Null languages count as ``und``; null
    and empty texts add nothing; repeated rows count each time; further columns are ignored; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    with scratch() as scope:
        blocks = materialise(_blocks(docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")), block), "blocks")
        vocabulary = _vocabulary(blocks, least, ranges)
        places = _places(blocks, vocabulary, ranges).repartitionById(ranges, "part").sortWithinPartitions("w1", "w2", "w3")
        grams = places.select("split", "w1", "w2", "w3", "n").mapInArrow(_add_up(least), "w1 long, w2 long, w3 long, n long")
        grams = materialise(grams, "grams")
        heads = grams.select(F.explode(F.array("w1", F.when(F.col("w3") > 0, F.col("w3")).otherwise(F.col("w2")))).alias("id"))
        heads = heads.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        heavy = materialise(heads.filter(F.col("n") > 2 * grams.count() / SHARE), "heavy")
        last = F.when(F.col("w3") > 0, F.col("w3")).otherwise(F.col("w2"))
        middle = F.when(F.col("w3") > 0, F.col("w2")).otherwise(F.col("w1"))
        before = F.when(F.col("w3") > 0, F.col("w1")).otherwise(F.lit(0))
        suffix = _ordered(vocabulary, grams, last, middle, before, heavy).select("o1", "o2", "o3", "n", "word")
        found = map_rows(suffix, _endings(least), "w1 long, w2 long, w3 long, n long, end long, ending long, last string, longer long")
        found = materialise(found, "endings")
        prefix = _ordered(vocabulary, found, F.col("w1"), F.col("w2"), F.col("w3"), heavy)
        prefix = prefix.select("o1", "o2", "o3", "n", "word", "lang", "last", "end", "ending", "longer")
        scored = map_rows(prefix, _beginnings, "lang string, phrase string, a long, l long, r long, score long")
        best = [F.desc("score"), F.desc("a"), F.col("phrase")]
        ranked = top_k_per(scored, ["lang"], best, top) if top else scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
        words = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
        return scope.keep(ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
