"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet to
the shared folder and reads back as the next stage's ``docs``. All stages but the last return the
columns of ``documents``, and each decides on all rows its predecessor kept. Null texts, repeated rows,
null ids and further columns are fine in every stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language, packing, quality, simhash_dedup, substring_dedup
from siltstone.plans.catalog import table
from siltstone.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned rule go.

    Rules are learned from the labels of this folder. Texts are judged where they are read: verdicts are
    column expressions, so no text moves.
    """
    rules = quality.learn(
        materialise(quality.statistics(docs).drop("doc"), "statistics"), table(spark, sf_dir, "labels")
    )
    judged = quality.judge(quality.statistics(docs, carry=COLUMNS), rules)
    return judged.filter("kept").select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which less than half the letters are in known words, go.

    Known words are of a script that a learned language uses, whatever the mix of languages. If no language
    could be learned (no labelled text), every document with letters stays.
    """
    found = language.predicted(language.train(docs))(F.col("text"))
    judged = docs.select(*COLUMNS, found.alias("found"))
    return judged.filter("found.known >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (Jaccard similarity of five-word shingles) stays: the smallest id's.

    Of rows that repeat in full one stays. Documents without an id yield to one with an id.
    """
    found = simhash_dedup.similar_documents(docs, shingle=5, similarity=0.8)
    keep = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id").distinct()
    kept = docs.select(*COLUMNS).join(keep, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too are cut out; documents with no word left go."""
    found = substring_dedup.remove_repeats(docs, window=35, carry=COLUMNS)
    text = F.coalesce("kept", "doc.text")
    left = found.filter("n_words > n_removed")
    return left.select("doc.doc_id", text.alias("text"), "doc.lang", "doc.source", F.length(text).cast("long").alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as token sequences of at most 4,096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_repeats", substring_repeats),
    ("best_fit", best_fit),
]

#: Trained rules, SimHash and token packing have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
