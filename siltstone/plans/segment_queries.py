"""Queries over the segmented index: loads, replacements, deletions, and block-max search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.segments import SegmentedIndex
from ..session import shared_path
from .catalog import query
from .search_queries import SQL_INDEX, SQL_QUESTIONS, questions, search_docs, sql_bm25


def _index(spark) -> SegmentedIndex:
    return SegmentedIndex(spark, shared_path(spark, "segments"), "doc_id").create("bigint")


def _is_deleted():
    return F.col("doc_id") % 7 == 3


def updated_index(spark, sf_dir) -> SegmentedIndex:
    """All documents in three loads: half of them, some of these still with another text; the rest and the right
    texts; then the deletion of one in seven."""
    docs, index = search_docs(spark, sf_dir), _index(spark)
    even, stale = F.col("doc_id") % 2 == 0, F.col("doc_id") % 10 == 0
    index.load(docs.filter(even).withColumn("content", F.when(stale, F.concat_ws(" ", "section", "content", "title")).otherwise(F.col("content"))))
    index.load(docs.filter(~even | stale))
    index.load(docs.limit(0), deleted=docs.filter(_is_deleted()).select("doc_id"))
    return index


@query(
    "WITH " + SQL_INDEX.replace("FROM documents", "FROM documents WHERE doc_id % 7 <> 3") + "," + SQL_QUESTIONS + "," + sql_bm25("qs", "b", 20)
    + " SELECT query_id, doc_id, score, rank FROM b_top"
)
def bm25_segmented(spark, sf_dir):
    """Ranking of an index that saw two loads, replacements and deletions: the same as of one built at once."""
    return updated_index(spark, sf_dir).topk(questions(spark, sf_dir), 20)


@query(
    "WITH " + SQL_INDEX.replace("FROM documents", "FROM documents WHERE doc_id % 7 <> 3") + " SELECT field, n AS n_docs, avgdl AS avg_dl FROM st"
)
def segment_statistics(spark, sf_dir):
    """Field statistics added over segments and corrections."""
    return updated_index(spark, sf_dir).statistics()


@query(
    "WITH " + SQL_INDEX + "," + SQL_QUESTIONS + "," + sql_bm25("qs", "b", 20, "('content', 1.0)") + " SELECT query_id, doc_id, score, rank FROM b_top"
)
def bm25_blocks(spark, sf_dir):
    """Block-max search of all documents loaded at once."""
    index = _index(spark)
    index.load(search_docs(spark, sf_dir))
    return index.topk(questions(spark, sf_dir), 20, {"content": 1.0})
