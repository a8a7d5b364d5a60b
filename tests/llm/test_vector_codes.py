"""Vector codes against plain k-means over Python integers."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siltstone.llm import vector_codes
from siltstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, parts=4, entries=256, rounds=4):
    """{position: (code, error, label_error)} and the digest, by brute force."""
    kept = [(i, l, [math.floor(1024 * float(x)) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[p][k] for k in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((apart(v, e), j) for j, e in enumerate(books[p])) for v in cut[p]] for p in range(parts)]
    for _ in range(rounds):
        for p, of in enumerate(assign()):
            for j in range(len(books[p])):
                mine = [cut[p][k] for k in range(len(kept)) if of[k][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    error = [sum(found[p][k][0] for p in range(parts)) for k in range(len(kept))]
    by_label = {}
    for (_, label, _), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    codes = ["".join(f"{found[p][k][1]:02x}" for p in range(parts)) for k in range(len(kept))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for (i, label, _), c, e in zip(kept, codes, error)), key=str), sha


def got(df):
    rows = df.collect()
    shas = {r.codebooks_sha256 for r in rows}
    return sorted(((r.id, r.code, r.error, r.label_error) for r in rows), key=str), shas.pop() if shas else None


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert got(QUERIES["op12_vector_codes"](spark, SF).withColumnRenamed("vec_id", "id")) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered_ties_and_odd_rows(spark, seed):
    draw = np.random.default_rng(seed)
    grid = draw.integers(-3, 4, (400, 8)) / 512.0  # many equal parts and equal distances
    near = draw.normal(0, 0.02, (300, 8)) + draw.integers(-2, 3, (300, 8))
    vectors = [v.tolist() for v in np.concatenate([grid, near])] + [[0.25] * 8] * 300  # one vector in a third of the rows
    rows = [(int(i) if i % 50 else None, v, int(i % 3) if i % 7 else None) for i, v in enumerate(vectors)]
    rows += [(5000, None, 1), (5001, [0.1, None] * 4, 1), (5002, [float("nan")] * 8, 2), (-1, [float("inf")] * 8, None), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    clashing = frame.select("*", *[F.lit("x").alias(c) for c in ("id", "whole", "code", "error", "n", "vector")])
    assert got(vector_codes.compress(clashing, entries=16)) == plain(exact, entries=16)
    assert vector_codes.compress(frame.limit(0)).collect() == []


def test_other_lengths_have_no_code(spark):
    rows = [(1, [1.0] * 4, 0), (2, [1.0] * 3, 0), (3, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.id: r.code for r in vector_codes.compress(frame).collect()} == {1: "00000000", 2: None, 3: None}
    assert {r.code for r in vector_codes.compress(frame.filter("vec_id = 2")).collect()} == {None}


def test_trees_hold_every_point_in_its_ball():
    points = np.random.default_rng(3).integers(-900, 900, (3000, 6))
    tree = vector_codes.build_tree(points, leaf=16)
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.stop[tree.left < 0] - tree.start[tree.left < 0]).max() <= 16
    for ball in range(len(tree.start)):
        inside = points[tree.order[tree.start[ball] : tree.stop[ball]]]
        assert (inside.sum(axis=0) == tree.total[ball]).all()
        assert np.linalg.norm(inside - tree.pivot[ball], axis=1).max() <= tree.radius[ball] * (1 + 1e-12)
    entries = points[:40]
    owned = sum(len(left) == 1 for _, left, _ in vector_codes.owners(tree, points, entries))
    assert owned > 0
