"""Vector search over quantised codes: every fiftieth vector is a query against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.vector_index import VectorIndex, fit
from ..session import materialise, shared_path
from .catalog import query, table

K = 20


def _sides(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return vectors, queries


def quantised(spark, sf_dir):
    """Two loads, of even and odd ids, in one index.

    The given vectors are close to random, so neighbours lie in many cells: twelve of sixteen are looked into.
    """
    vectors, queries = _sides(spark, sf_dir)
    index = VectorIndex(spark, shared_path(spark, "vector-index")).create(fit(vectors, cells=16, parts=16))
    index.add(vectors.filter("doc_id % 2 = 0"), 0).add(vectors.filter("doc_id % 2 <> 0"), 1)
    return index.search(vectors, queries, K, probes=12)


@query()
def knn_quantised(spark, sf_dir):
    return quantised(spark, sf_dir)


@query("SELECT COUNT(*) AS queries, TRUE AS recall_ok FROM embeddings WHERE vec_id % 50 = 0")
def quantised_recall(spark, sf_dir):
    """Whether nine in ten of the exact 20 nearest are found; the exact search is the expectation."""
    vectors, queries = _sides(spark, sf_dir)
    exact = materialise(S.knn_topk(vectors, queries, K), "exact").select("query_id", "doc_id")
    hits = quantised(spark, sf_dir).select("query_id", "doc_id", F.lit(1).alias("hit"))
    found = exact.join(hits, ["query_id", "doc_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_ok"))
