"""The segmented index: what loads write, merges, ties with an index built at once, and blocks left shut."""

import os

import pytest
from pyspark.sql import functions as F
from siltstone.operators import search as S
from siltstone.operators.segments import SegmentedIndex, term_counts
from siltstone.session import shared_path

FIELDS = ("content", "title", "section")
WORDS = [f"w{i}" for i in range(40)]


def docs(spark, ids, salt=0):
    rows = []
    for i in ids:
        words = [WORDS[(i * 7 + j * j + salt) % (3 + (i + j) % 37)] for j in range(5 + i % 50)]
        rows.append((i, " ".join(words), words[0], f"sec{i % 3}"))
    return spark.createDataFrame(rows, "doc_id long, content string, title string, section string")


@pytest.fixture
def index(spark):
    return SegmentedIndex(spark, shared_path(spark, "test-segments"), "doc_id", FIELDS, fan=3).create("bigint")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w30"), (2, "w5 w5 w0"), (3, "unknown"), (4, "w7 sec1")], "query_id long, query string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def files(index, name):
    return {os.path.join(at, f) for at, _, found in os.walk(index.path.removeprefix("file:") + "/" + name) for f in found if f.endswith(".parquet")}


def test_updates_equal_an_index_built_at_once(spark, index):
    none = spark.createDataFrame([], "doc_id long, content string, title string, section string")
    assert index.topk(asked(spark), 5).collect() == [] and index.load(none).written == 0
    first = index.load(docs(spark, range(300)))
    assert (first.written, first.tombstones) == (300, 0)
    before = files(index, "blocks")
    second = index.load(docs(spark, [*range(290, 400), 5], salt=3))
    assert (second.written, second.tombstones, second.merged) == (111, 11, [])
    new = files(index, "blocks") - before
    assert before <= files(index, "blocks")  # nothing of the first segment was written again
    assert {r.doc_id for r in spark.read.parquet(*new).select(F.inline("entries")).collect()} == {*range(290, 400), 5}
    third = index.load(none, deleted=spark.range(0, 60, 2).withColumnRenamed("id", "doc_id"))
    assert (third.written, third.tombstones) == (0, 30)
    truth = docs(spark, range(290)).unionByName(docs(spark, range(290, 400), salt=3)).filter("doc_id <> 5").unionByName(docs(spark, [5], salt=3))
    truth = truth.filter("doc_id >= 60 or doc_id % 2 = 1")
    want = rows(S.bm25_topk(truth, asked(spark), 10, "doc_id"))
    assert want and rows(index.topk(asked(spark), 10)) == want
    again = index.load(docs(spark, [700, 701]))
    assert len(again.merged) == 3 and list(index.segments().values()) == [1]
    want = rows(S.bm25_topk(truth.unionByName(docs(spark, [700, 701])), asked(spark), 10, "doc_id"))
    assert rows(index.topk(asked(spark), 10)) == want
    assert {r.field: r.n_docs for r in index.statistics().collect()} == {f: 372 for f in FIELDS}


def test_bad_rows_are_counted(spark, index):
    odd = spark.createDataFrame(
        [(None, "no id", "t", "s"), (1, None, None, None), (2, "", "", ""), (3, "same id", "a", "b"), (3, "same id", "a", "b"), (4, "word " * 50_000, "t", "s")],
        "doc_id long, content string, title string, section string",
    )
    report = index.load(odd.withColumn("segment", F.lit("x")).withColumn("range", F.lit("y")))
    assert (report.written, report.rejected) == (4, 1)
    q = spark.createDataFrame([(1, "word same")], "query_id long, query string")
    assert {r.doc_id for r in index.topk(q, 5).collect()} == {3, 4}


def test_common_terms_open_few_blocks(spark, index):
    text = F.concat_ws(" ", F.lit("common"), F.expr("array_join(array_repeat('filler', cast(5 + id % 400 as int)), ' ')"), F.when(F.col("id") % 97 == 0, "common common"))
    many = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("content"), F.lit("t").alias("title"), F.lit("s").alias("section"))
    index.load(many)
    q = spark.createDataFrame([(1, "common")], "query_id long, query string")
    read = index.postings_read(q, 10).first()
    assert read.postings == 6000 and 5 * read.opened < read.postings
    assert rows(index.topk(q, 10)) == rows(S.bm25_topk(many, q, 10, "doc_id"))


def test_term_counts(spark):
    frame = spark.createDataFrame([(["a", "b", "b"],), ([],), (None,), (["x"] * 5,)], "t array<string>")
    assert [[tuple(x) for x in r.e] for r in frame.select(term_counts("t").alias("e")).collect()] == [[("a", 1), ("b", 2)], [], [], [("x", 5)]]


def test_a_load_moves_postings_once(spark, tmp_path, monkeypatch):
    """The blocks of a term are made where they are written: one exchange between documents and blocks."""
    from siltstone.operators import segments as G

    plans = {}
    append = G.SegmentedIndex._append

    def seen(self, df, name, *partitions):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        append(self, df, name, *partitions)

    monkeypatch.setattr(G.SegmentedIndex, "_append", seen)
    docs = spark.createDataFrame([("a", "x y x"), ("a", "x z"), ("b", "y"), (None, "y")], "chunk_id string, content string")
    load = G.SegmentedIndex(spark, str(tmp_path / "one"), fields=("content",)).create().load(docs)
    assert (load.written, load.rejected) == (2, 1)
    assert plans["blocks"].count("Exchange") == 1 and plans["terms"].count("Exchange") == 1
