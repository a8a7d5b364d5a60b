"""Approximate vector search by coarse cells and product-quantised codes, with exact scores at the end.

A vector is stored as its cell and one byte per part: the nearest entry of that part's codebook to what is left
of the vector once the cell's centre is taken off. A search looks into the cells nearest to a query, adds up
table look-ups instead of multiplying vectors, and only the best candidates meet their real vectors by a join.

Cells and codebooks are fitted on at most about ``sample_rows`` vectors, chosen by a hash of their key; every vector
is coded. Loads are added as folders of their own and leave earlier ones alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot, doubles
from ..session import materialise, small_batches
from .ranks import top_k_per

ENTRIES = 256  # one byte per part
BLOCK = 4_096  # codes, or queries divided by 16, that are scored together
HELD = 2_000  # queries whose best candidates a task keeps before it passes them on


def _nearest(points: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    apart = (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.argmin(apart, axis=1)[:, None] if n == 1 else np.argsort(apart, axis=1, kind="stable")[:, :n]


def _lloyd(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``points``, which come in the order of a hash: the first distinct ones start."""
    starts = np.sort(np.unique(points, axis=0, return_index=True)[1])[:k]
    centres = points[starts].copy()
    for _ in range(rounds):
        of = _nearest(points, centres)[:, 0]
        counts = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, column, len(centres)) for column in points.T], axis=1)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Cell centres ``(cells, length)`` and codebooks ``(parts, entries, part length)`` for vectors of one length."""

    cells: np.ndarray
    books: np.ndarray
    length: int

    def matrix(self, rows: list) -> np.ndarray:
        """Rows as a matrix, filled up with zeros to a multiple of the number of parts."""
        width = self.books.shape[0] * self.books.shape[2]
        out = np.zeros((len(rows), width))
        out[:, : self.length] = np.array(rows, dtype=float).reshape(len(rows), self.length)
        return out

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(points, self.cells)[:, 0]
        rest = points - self.cells[cell]
        size = self.books.shape[2]
        codes = [_nearest(rest[:, m * size : (m + 1) * size], book)[:, 0] for m, book in enumerate(self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def look_up(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of all ``queries`` with the coded vectors of a cell."""
        size = self.books.shape[2]
        scores = np.repeat((queries @ self.cells[cell])[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            scores += (queries[:, m * size : (m + 1) * size] @ book.T)[:, codes[:, m]]
        return scores


def fit(vectors: DataFrame, cells: int, parts: int = 8, sample_rows: int = 50_000) -> Quantiser:
    """Cells and codebooks for the ``vectors`` (``doc_id, embedding``) of the most frequent length; others are left out.

    ``sample_rows`` bounds what reaches the driver; give at least some forty per cell.
    """
    usable = _usable(vectors, None)
    lengths = usable.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    if most is None:
        raise ValueError("no vector to fit an index on")
    length, total = most
    usable = _usable(vectors, length)
    share = int(min(1.0, sample_rows / total) * (1 << 20)) or 1
    digest = F.xxhash64("doc_id")
    sample = usable.filter(F.pmod(digest, F.lit(1 << 20)) < share).orderBy(digest, "doc_id").select("embedding").toArrow().column(0).to_pylist()
    size = -(-length // parts)
    points = np.zeros((len(sample), size * parts))
    points[:, :length] = np.array(sample, dtype=float)
    centres = _lloyd(points, cells)
    rest = points - centres[_nearest(points, centres)[:, 0]]
    books = [_lloyd(rest[:, m * size : (m + 1) * size], ENTRIES) for m in range(parts)]
    entries = max(len(b) for b in books)
    filled = [np.concatenate([b, np.repeat(b[:1], entries - len(b), axis=0)]) for b in books]
    return Quantiser(centres, np.stack(filled), length)


def _usable(vectors: DataFrame, length: int | None) -> DataFrame:
    """Rows with a key and a vector of finite numbers, of ``length`` if it is given."""
    plain = vectors.withColumn("embedding", doubles("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = plain.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~odd)
    return kept if length is None else kept.filter(F.size("embedding") == length)


class VectorIndex:
    """Codes under ``path``: ``model``, and per load ``codes/load=<n>`` and ``layout/load=<n>``.

    A cell with many vectors is split into parts of about ``part_rows`` codes by a hash of the key; the layout says into how
    many. Vectors that are null, of another length or with null or non-finite numbers are not in the index.
    """

    def __init__(self, spark: SparkSession, path: str, part_rows: int = 200_000) -> None:
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    def create(self, model: Quantiser) -> VectorIndex:
        rows = [("cell", 0, i, [float(x) for x in c]) for i, c in enumerate(model.cells)]
        rows += [("book", m, i, [float(x) for x in e]) for m, book in enumerate(model.books) for i, e in enumerate(book)]
        rows.append(("length", 0, model.length, []))
        self.spark.createDataFrame(rows, "kind string, part int, entry int, numbers array<double>").write.parquet(f"{self.path}/model")
        return self

    def model(self) -> Quantiser:
        rows = self.spark.read.parquet(f"{self.path}/model").orderBy("kind", "part", "entry").collect()
        cells = np.array([r.numbers for r in rows if r.kind == "cell"])
        parts = 1 + max(r.part for r in rows)
        books = np.array([r.numbers for r in rows if r.kind == "book"]).reshape(parts, -1, cells.shape[1] // parts)
        return Quantiser(cells, books, next(r.entry for r in rows if r.kind == "length"))

    def add(self, vectors: DataFrame, load: int) -> VectorIndex:
        """Code ``vectors`` (``doc_id, embedding``) as load ``load``; a load that is there already is replaced."""
        small_batches(self.spark)
        model = self.model()
        key = vectors.schema["doc_id"].dataType
        arrow_key = to_arrow_type(key)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = model.encode(model.matrix(batch.column(1).to_pylist()))
                    columns = [batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "cell", "code"])

        usable = _usable(vectors, model.length).select("doc_id", "embedding")
        coded = materialise(usable.mapInArrow(encode, f"doc_id {key.simpleString()}, cell int, code binary"), "codes")
        layout = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.part_rows).cast("int").alias("parts"))
        layout.write.mode("overwrite").parquet(f"{self.path}/layout/load={load}")
        layout = self.spark.read.schema("cell int, parts int").parquet(f"{self.path}/layout/load={load}")  # one row per cell: small by parameter
        placed = coded.join(layout, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "code")
        laid = placed.repartition("cell", "part").sortWithinPartitions("cell", "part")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, parts = (batch.column(i).to_numpy() for i in (0, 1))
                edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0)) + 1
                for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                    for start in range(low, high, BLOCK):
                        some = batch.slice(start, min(BLOCK, high - start))
                        ids = pa.array([some.column(2).to_pylist()], pa.list_(arrow_key))
                        codes = pa.array([b"".join(some.column(3).to_pylist())], pa.binary())
                        columns = [pa.array([cells[start]], pa.int32()), pa.array([parts[start]], pa.int32()), ids, codes]
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "part", "ids", "codes"])

        blocks = laid.mapInArrow(pack, f"cell int, part int, ids array<{key.simpleString()}>, codes binary")
        blocks.write.mode("overwrite").parquet(f"{self.path}/codes/load={load}")
        return self

    def candidates(self, queries: DataFrame, n: int, probes: int) -> DataFrame:
        """``query_id, doc_id, score, rank``: the ``n`` best by codes among the ``probes`` nearest cells of each query."""
        small_batches(self.spark)
        model = self.model()
        query_type = queries.schema["query_id"].dataType
        blocks = self.spark.read.parquet(f"{self.path}/codes")
        doc_type = blocks.schema["ids"].dataType.elementType
        arrow_query, arrow_doc = to_arrow_type(query_type), to_arrow_type(doc_type)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Queries of a batch that look into the same cell, as blocks."""
            for batch in batches:
                ids = batch.column(0).to_pylist()
                points = model.matrix(batch.column(1).to_pylist())
                near = _nearest(points, model.cells, probes)
                for cell in np.unique(near).tolist():
                    at = np.flatnonzero((near == cell).any(axis=1))
                    for start in range(0, len(at), BLOCK // 16):
                        some = at[start : start + BLOCK // 16]
                        columns = [pa.array([cell], pa.int32()), pa.array([[ids[i] for i in some]], pa.list_(arrow_query)), pa.array([points[some].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["cell", "query_ids", "points"])

        asked = _usable(queries, model.length).select("query_id", "embedding")
        asked = asked.mapInArrow(probe, f"cell int, query_ids array<{query_type.simpleString()}>, points binary")
        layout = self.spark.read.parquet(f"{self.path}/layout")
        spread = asked.join(layout, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = blocks.join(spread, ["load", "cell", "part"]).select("cell", "ids", "codes", "query_ids", "points")
        schema = f"query_id {query_type.simpleString()}, doc_id {doc_type.simpleString()}, score double"

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {}

            def found() -> pa.RecordBatch:
                columns = [[q for q, (s, _) in best.items() for _ in range(len(s))], [i for _, ids in best.values() for i in ids], [x for s, _ in best.values() for x in s]]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow_query, arrow_doc, pa.float64()))], names=["query_id", "doc_id", "score"])

            for batch in batches:
                # one pair of blocks at a time: the pairs of a batch hold their blocks many times over
                for cell, ids, codes, qids, points in ([c[at].as_py() for c in batch.columns] for at in range(batch.num_rows)):
                    coded = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                    scores = model.look_up(np.frombuffer(points).reshape(len(qids), -1), cell, coded)
                    for qid, row in zip(qids, scores):
                        top = np.argpartition(-row, n)[:n] if len(row) > n else np.arange(len(row))
                        s, i = row[top].tolist(), [ids[t] for t in top]
                        if qid in best:
                            s, i = best[qid][0] + s, best[qid][1] + i
                            keep = np.argsort(-np.array(s), kind="stable")[:n]
                            s, i = [s[t] for t in keep], [i[t] for t in keep]
                        best[qid] = (s, i)
                    if len(best) > HELD:
                        yield found()
                        best.clear()
            yield found()

        return top_k_per(pairs.mapInArrow(score, schema), ["query_id"], [F.desc("score"), F.col("doc_id")], n)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int, n: int | None = None) -> DataFrame:
        """``query_id, doc_id, score, rank`` with exact inner products of the best ``n`` (ten times ``k``) candidates.

        ``vectors`` holds the current vectors: a candidate that is no longer there is left out, one that was replaced is scored as
        it is now. Queries without a usable vector find nothing.
        """
        close = self.candidates(queries, n or 10 * k, probes).select("query_id", "doc_id").distinct()
        asked = queries.select("query_id", F.col("embedding").alias("asked"))
        # the short list meets the vectors first: only vectors that are somebody's candidate move on
        scored = close.join(vectors.select("doc_id", "embedding"), "doc_id").join(asked, "query_id")
        scored = scored.select("query_id", "doc_id", F.round(dot(doubles("embedding"), doubles("asked")), 6).alias("score"))
        return top_k_per(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
