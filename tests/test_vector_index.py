"""The quantised index against an exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.operators import search as S
from siltstone.operators.vector_index import VectorIndex, fit
from siltstone.plans.catalog import table

SF_DIR = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.1")


def exact(vectors, queries, k):
    return {(r.query_id, r.doc_id): r.score for r in S.knn_topk(vectors, queries, k).collect()}


def test_recall_on_the_given_vectors(spark, tmp_path):
    vectors = table(spark, SF_DIR, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    index = VectorIndex(spark, str(tmp_path / "index")).create(fit(vectors, cells=16, parts=16)).add(vectors, 0)
    got = {(r.query_id, r.doc_id): r.score for r in index.search(vectors, queries, 20, probes=12).collect()}
    want = exact(vectors, queries, 20)
    recall = len(got.keys() & want.keys()) / len(want)
    print(f"recall@20 {recall:.3f} over {len(want) // 20} queries")
    assert recall >= 0.9
    assert all(abs(got[pair] - want[pair]) < 1e-5 for pair in got.keys() & want.keys())


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=10)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 10), (1003, [None] * 10), (1004, [])]
    return spark.createDataFrame(rows + odd, "doc_id long, embedding array<double>")


def test_all_cells_and_candidates_are_exact_whatever_the_splits(spark, points, tmp_path):
    queries = points.filter("doc_id % 30 = 0 OR doc_id > 999").select(F.col("doc_id").alias("query_id"), "embedding")
    good = points.filter("doc_id < 1000")
    want = exact(good, queries.filter("query_id < 1000"), 5)
    index = VectorIndex(spark, str(tmp_path / "index"), part_rows=10).create(fit(points, cells=4, parts=4))
    index.add(points.filter("doc_id < 100"), 0).add(points.filter("doc_id >= 100"), 1).add(points.filter("doc_id >= 100"), 1)
    got = {(r.query_id, r.doc_id): r.score for r in index.search(points, queries, 5, probes=4, n=300).collect()}
    assert got == want
    few = points.filter("doc_id <> 7")  # a deleted vector is no hit, though its code is still there
    assert 7 not in {r.doc_id for r in index.search(few, queries, 5, probes=4, n=300).collect()}
    assert index.search(points, queries.limit(0), 5, probes=4).count() == 0


def test_nothing_to_fit(spark, points):
    with pytest.raises(ValueError):
        fit(points.filter("doc_id > 999 AND doc_id <> 1001"), cells=2)


def test_fitting_does_not_sort_all_entries_for_the_nearest_one(monkeypatch):
    import numpy as np
    from siltstone.operators import vector_index as X

    points = np.random.default_rng(3).integers(0, 4, (500, 8)).astype(float)
    centres = points[:40]
    apart = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(np, "argsort", None)
    assert (X._nearest(points, centres)[:, 0] == apart.argmin(axis=1)).all()
