"""An inverted index that grows: immutable segments, tombstones, tiered merging, and block-max top-k.

A load writes one segment with the new documents and nothing of the others. A document that was replaced or
deleted gets a tombstone in its old segment, and its counts are written once more with a minus sign, so
statistics are sums over live segments and a ranking equals that of an index built at once. Segments of one tier are
merged into one of the next when there are enough of them; only then are their postings written again.

Inside a segment documents are ranked by length and cut into ranges of ``RANGE``. The postings of a term in a range
are one block with the largest count and the smallest length in it, which bound every score of the block
for whatever average length holds by then. A search scores the ranges with the largest bounds first, takes the
k-th score as threshold, and then opens only ranges whose bound reaches it; the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import index_terms
from ..session import materialise, scratch
from .ranks import top_k_per
from .search import FIELD_BOOSTS, K1, Analyzer, B, _bucket, query_terms, term_counts

RANGE_BITS = 6
RANGE = 1 << RANGE_BITS
#: A batch with no more distinct terms than this has them pushed into the scan.
PUSHED_TERMS = 500
_EXACT = 1e-6  # scores are rounded to six digits


@dataclass(frozen=True)
class Load:
    """What a load did: documents written, rows without an id, documents replaced or deleted, segments merged."""

    written: int
    rejected: int
    tombstones: int
    merged: list[str] = field(default_factory=list)


def _saturation(tf: Column | str, dl: Column | str) -> Column:
    tf, dl = (F.col(c) if isinstance(c, str) else c for c in (tf, dl))
    return tf / (tf + K1 * (1 - B + B * dl / F.col("avg_dl")))


@dataclass(frozen=True)
class SegmentedIndex:
    """The index under ``path`` on shared storage. One writer at a time; a search sees whole loads only.

    A load counts once its row stands in the log; what a failed load left is never read.
    """

    spark: SparkSession
    path: str
    doc_id: str = "chunk_id"
    fields: tuple[str, ...] = tuple(FIELD_BOOSTS)
    analyze: Analyzer = index_terms
    fan: int = 4

    # -------------------------------------------------------------- tables

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _append(self, df: DataFrame, name: str, *partitions: str) -> None:
        df.write.mode("append").partitionBy(*partitions).parquet(self._at(name))

    def _read(self, name: str, segments: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(self._at(name)).filter(F.col("segment").isin(list(segments)))

    def create(self, doc_type: str = "string") -> SegmentedIndex:
        """Empty log, tombstones and corrections; call once per path."""
        empty = {
            "log": "version long, action string, segment string, tier int, docs long",
            "dead": f"segment string, doc_id {doc_type}",
            "term_corrections": "segment string, bucket int, field string, term string, df long, cf long",
            "field_corrections": "segment string, field string, n_docs long, sum_dl long",
        }
        for name, schema in empty.items():
            self.spark.createDataFrame([], schema).coalesce(1).write.parquet(self._at(name))
        return self

    def _log(self) -> list:
        return sorted(self.spark.read.parquet(self._at("log")).collect(), key=lambda r: r.version)

    def segments(self) -> dict[str, int]:
        """Live segments and their tiers; the log has one row per load and a few per merge."""
        live: dict[str, int] = {}
        for row in self._log():
            if row.action == "add":
                live[row.segment] = row.tier
            else:
                live.pop(row.segment, None)
        return live

    def _commit(self, added: tuple[str, int, int] | None, removed: Sequence[str] = ()) -> None:
        version = max((r.version for r in self._log()), default=0) + 1
        rows = [(version, "remove", name, None, None) for name in removed]
        rows += [(version, "add", *added)] if added else []
        log = self.spark.createDataFrame(rows, "version long, action string, segment string, tier int, docs long")
        self._append(log.coalesce(1), "log")

    # -------------------------------------------------------------- writing

    def _forward(self, docs: DataFrame) -> DataFrame:
        """One row per document: ``doc_id``, the row's place, ``total, fields`` (name, length, term counts)."""

        def counted(name: str) -> Column:
            return let(F.sort_array(self.analyze(F.col(name))), lambda t: F.struct(
                F.lit(name).alias("field"), F.coalesce(F.greatest(F.size(t), F.lit(0)), F.lit(0)).alias("dl"), term_counts(t).alias("entries")
            ))

        rows = docs.select(
            F.col(self.doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.array(*[counted(f) for f in self.fields]).alias("fields")
        )
        return rows.withColumn("total", F.aggregate("fields", F.lit(0), lambda n, f: n + f["dl"])).select("doc_id", "place", "total", "fields")

    def _write(self, forward: DataFrame, segment: str) -> int:
        """A segment from forward rows; returns its number of documents."""
        ordered = forward.repartitionByRange("total", "doc_id").sortWithinPartitions("total", "doc_id")
        ranged = ordered.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))
        self._append(ranged.withColumn("segment", F.lit(segment)), "forward", "segment")
        stored = self._read("forward", [segment])
        flat = stored.select("doc_id", "range", F.inline("fields"))
        lengths = flat.filter(F.col("dl") > 0).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("sum_dl"))
        self._append(lengths.withColumn("segment", F.lit(segment)), "fields", "segment")
        posts = flat.select("doc_id", "range", "field", "dl", F.inline("entries"))
        # Postings move once: to the place where their block is made and written.
        placed = posts.withColumn("bucket", _bucket("term")).withColumn("spread", F.pmod(F.xxhash64("range"), F.lit(8)))
        blocks = placed.repartition("bucket", "spread").groupBy("bucket", "spread", "field", "term", "range").agg(
            F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("n"), F.sum("tf").alias("cf"),
            F.collect_list(F.struct("doc_id", "tf", "dl")).alias("entries"),  # RANGE documents at most
        )
        laid = blocks.drop("spread").withColumn("segment", F.lit(segment)).sortWithinPartitions("bucket", "term", "field", "range")
        self._append(laid, "blocks", "segment", "bucket")
        counts = self._read("blocks", [segment]).select("bucket", "field", "term", "n", "cf").repartition("bucket")
        terms = counts.groupBy("bucket", "field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        terms = terms.withColumn("segment", F.lit(segment)).sortWithinPartitions("bucket", "term")
        self._append(terms, "terms", "segment", "bucket")
        return stored.count()

    def _bury(self, live: Sequence[str], touched: DataFrame) -> int:
        """Tombstones and corrections for the touched documents that live in older segments."""
        here = self._read("forward", live)
        dead = self._read("dead", live)
        held = here.select("segment", "doc_id").join(dead, ["segment", "doc_id"], "left_anti")
        hits = materialise(held.join(touched, "doc_id", "left_semi").select("segment", "doc_id"), "buried")
        gone = here.join(hits, ["segment", "doc_id"]).select("segment", F.inline("fields"))
        lengths = gone.filter(F.col("dl") > 0).groupBy("segment", "field").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("dl")).alias("sum_dl"))
        counts = gone.select("segment", "field", F.inline("entries")).groupBy("segment", "field", "term")
        counts = counts.agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf")).withColumn("bucket", _bucket("term"))
        self._append(lengths, "field_corrections")
        self._append(counts.select("segment", "bucket", "field", "term", "df", "cf"), "term_corrections")
        self._append(hits, "dead")
        return hits.count()

    def load(self, docs: DataFrame, deleted: DataFrame | None = None) -> Load:
        """Add or replace ``docs`` and remove the ids of ``deleted`` (a column of the id's name), then merge if due.

        Of rows with one id the last counts; rows without an id are counted and left out. A document that is
        both deleted and loaded is loaded. Texts of other documents are neither read nor written.
        """
        with scratch():
            rows = materialise(self._forward(docs), "incoming")
            forward = rows.filter(F.col("doc_id").isNotNull())
            rejected = rows.count() - forward.count()
            last = forward.groupBy("doc_id").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            if not last.isEmpty():  # only ids that repeat meet their last row
                forward = forward.join(last.select("doc_id", "last"), "doc_id", "left").filter("last IS NULL OR place = last").drop("last")
            forward = forward.drop("place")
            touched = forward.select("doc_id")
            if deleted is not None:
                touched = touched.unionByName(deleted.select(F.col(self.doc_id).alias("doc_id"))).distinct()
            live = list(self.segments())
            segment = f"s{len(self._log()) + 1:08d}"
            written = 0 if forward.isEmpty() else self._write(forward, segment)
            # Tombstones name older segments only and come last before the log, so a failed load can be run again.
            buried = self._bury(live, touched) if live else 0
            if written:
                self._commit((segment, 0, written))
        return Load(written, rejected, buried, self.merge())

    def merge(self) -> list[str]:
        """Merge tiers that have ``fan`` segments or more, smallest tier first; names of the segments that went."""
        gone: list[str] = []
        while True:
            tiers: dict[int, list[str]] = {}
            for name, tier in self.segments().items():
                tiers.setdefault(tier, []).append(name)
            due = min((t for t, names in tiers.items() if len(names) >= self.fan), default=None)
            if due is None:
                return gone
            names = sorted(tiers[due])
            living = self._read("forward", names).join(self._read("dead", names), ["segment", "doc_id"], "left_anti")
            segment = f"s{len(self._log()) + 1:08d}m"
            with scratch():
                kept = materialise(living.select("doc_id", "total", "fields"), "merge")
                size = 0 if kept.isEmpty() else self._write(kept, segment)
            self._commit((segment, due + 1, size) if size else None, names)
            gone += names

    # -------------------------------------------------------------- reading

    def statistics(self) -> DataFrame:
        """``field, n_docs, avg_dl`` over living documents: sums over segments and corrections."""
        live = list(self.segments())
        both = self._read("fields", live).select("field", "n_docs", "sum_dl").unionByName(
            self._read("field_corrections", live).select("field", "n_docs", "sum_dl")
        )
        total = both.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")).filter("n_docs > 0")
        return total.select("field", "n_docs", (F.col("sum_dl") / F.col("n_docs")).alias("avg_dl"))

    def _wanted(self, name: str, live: Sequence[str], buckets: list[int], terms: list[str] | None) -> DataFrame:
        found = self._read(name, live).filter(F.col("bucket").isin(buckets))
        return found.filter(F.col("term").isin(terms)) if terms is not None else found

    def _opened(self, queries: DataFrame, k: int, boosts: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Blocks of the asked terms with their weights; scores of all documents that can be in the top ``k``; ranges with bounds."""
        live = list(self.segments())
        asked = materialise(query_terms(queries, self.analyze), "query-terms")
        distinct = asked.select("term").distinct()
        few = [r.term for r in distinct.limit(PUSHED_TERMS + 1).collect()]
        terms = few if len(few) <= PUSHED_TERMS else None
        buckets = [r.bucket for r in distinct.select(_bucket("term")).distinct().collect()]
        named = F.col("field").isin(list(boosts))
        counts = ["field", "term", "df", "cf"]
        counted = self._wanted("terms", live, buckets, terms).select(*counts).unionByName(
            self._wanted("term_corrections", live, buckets, terms).select(*counts)
        )
        counted = counted.filter(named).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = counted.join(self.statistics(), "field").join(asked, "term")
        weights = materialise(weights.select("query_id", "field", "term", (F.col("qtf") * idf).alias("weight"), "avg_dl"), "weights")
        blocks = self._wanted("blocks", live, buckets, terms).join(weights, ["field", "term"])

        impact = F.col("weight") * _saturation("max_tf", "min_dl")
        key = ["query_id", "segment", "range"]
        ranges = blocks.select(*key, "field", impact.alias("w"), "n").groupBy(*key).agg(_best(boosts).alias("bound"), F.sum("n").alias("n"))
        ranges = materialise(ranges, "ranges")
        order = [F.desc("bound"), F.col("segment"), F.col("range")]
        first = materialise(top_k_per(ranges, ["query_id"], order, -(-k // RANGE) + 1, "turn"), "first-ranges")
        dead = self._read("dead", live)

        def scored(chosen: DataFrame) -> DataFrame:
            posts = blocks.join(chosen.select(*key), key).select(*key, "field", "weight", "avg_dl", F.inline("entries"))
            posts = posts.join(dead, ["segment", "doc_id"], "left_anti")
            w = posts.select("query_id", "doc_id", "field", (F.col("weight") * _saturation("tf", "dl")).alias("w"))
            return w.groupBy("query_id", "doc_id").agg(F.round(_best(boosts), 6).alias("score"))

        early = materialise(scored(first), "early")
        kth = top_k_per(early, ["query_id"], [F.desc("score")], k, "turn").filter(F.col("turn") == k)
        threshold = kth.select("query_id", F.col("score").alias("least"))
        rest = ranges.join(first.select(*key), key, "left_anti").join(threshold, "query_id", "left")
        rest = materialise(rest.filter(F.col("bound") + _EXACT >= F.coalesce("least", F.lit(0.0))).select(*key, "n"), "more-ranges")
        opened = first.select(*key, "n").unionByName(rest)
        return early.unionByName(scored(rest)), ranges, opened

    def topk(self, queries: DataFrame, k: int, boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
        """``query_id, doc_id, score, rank``: exact BM25 over living documents. No text is read.

        An index without segments gives no rows; so do questions without a known term.
        """
        if not self.segments():
            doc_type = self.spark.read.parquet(self._at("dead")).schema["doc_id"].dataType.simpleString()
            query_type = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {query_type}, doc_id {doc_type}, score double, rank int")
        with scratch() as scope:
            scores, _, _ = self._opened(queries, k, boosts)
            return scope.keep(top_k_per(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k), "hits")

    def postings_read(self, queries: DataFrame, k: int, boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
        """``query_id, postings, opened``: postings of the question's terms, and those whose block was opened."""
        with scratch() as scope:
            _, ranges, opened = self._opened(queries, k, boosts)
            all_ = ranges.groupBy("query_id").agg(F.sum("n").alias("postings"))
            return scope.keep(all_.join(opened.groupBy("query_id").agg(F.sum("n").alias("opened")), "query_id"), "reads")


def _best(boosts: dict[str, float]) -> Column:
    """Best boosted field sum of ``w`` over rows with ``field`` (an aggregate)."""
    sums = [F.coalesce(F.sum(F.when(F.col("field") == name, F.col("w"))), F.lit(0.0)) * boost for name, boost in boosts.items()]
    return F.greatest(*sums) if len(sums) > 1 else sums[0]
