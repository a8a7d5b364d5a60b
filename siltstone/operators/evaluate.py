"""Retrieval and answer quality over tables of ranked hits and golden cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER_MARKER
from ..functions.urls import eval_url


def ranked_urls(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Collapse hits to documents: first rank per page URL, renumbered from 1 (``pos``).

    A question has at most as many hits as were retrieved, so the window per question is small.
    """
    firsts = (
        hits.withColumn("doc_url", eval_url("url"))
        .filter(F.col("doc_url") != "")
        .groupBy(key, "doc_url")
        .agg(F.min("rank").alias("rank"))
    )
    return firsts.select(key, "doc_url", F.row_number().over(Window.partitionBy(key).orderBy("rank", "doc_url")).alias("pos"))


def expected_urls(cases: DataFrame, key: str = "query_id") -> DataFrame:
    """Distinct relevant page URLs per question."""
    return cases.select(key, F.explode("expected_urls").alias("_u")).select(key, eval_url("_u").alias("doc_url")).distinct()


def retrieval_metrics(
    ranked: DataFrame, relevant: DataFrame, queries: DataFrame, precision_k: int = 5, recall_k: int = 10,
    key: str = "query_id",
) -> DataFrame:
    """One row per question: precision, recall, reciprocal rank and NDCG, not yet rounded.

    Precision divides by k even for short lists; with nothing relevant recall and NDCG are 1.
    """
    n_relevant = relevant.groupBy(key).agg(F.count(F.lit(1)).alias("n_relevant"))
    found = ranked.join(relevant.withColumn("_hit", F.lit(True)), [key, "doc_url"], "left_semi")
    sums = found.groupBy(key).agg(
        F.count_if(F.col("pos") <= precision_k).alias("p_hits"),
        F.count_if(F.col("pos") <= recall_k).alias("r_hits"),
        F.min("pos").alias("first_pos"),
        F.sum(F.when(F.col("pos") <= recall_k, 1.0 / F.log2(F.col("pos") + 1))).alias("dcg"),
    )
    n = F.coalesce("n_relevant", F.lit(0))
    ideal_hits = F.least(n, F.lit(recall_k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(ideal_hits, F.lit(1))), F.lit(0.0),
                        lambda acc, i: acc + 1.0 / F.log2(i + 1))
    return (
        queries.join(n_relevant, key, "left")
        .join(sums, key, "left")
        .select(
            *queries.columns,
            (F.coalesce("p_hits", F.lit(0)) / precision_k).alias(f"precision_at_{precision_k}"),
            F.when(n == 0, 1.0).otherwise(F.coalesce("r_hits", F.lit(0)) / F.greatest(n, F.lit(1))).alias(f"recall_at_{recall_k}"),
            F.when(F.col("first_pos").isNull(), 0.0).otherwise(1.0 / F.greatest("first_pos", F.lit(1))).alias("mrr"),
            F.when(n == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias(f"ndcg_at_{recall_k}"),
        )
    )


def said_no_answer(answer: Column | str) -> Column:
    return F.contains(F.col(answer) if isinstance(answer, str) else answer, F.lit(NO_ANSWER_MARKER))


def task_completed(expect_answer: Column | str, answer: Column | str, grounded: Column | str) -> Column:
    """Answerable: answered and grounded. Negative probe: said that nothing was found."""
    expect_answer, grounded = (F.col(c) if isinstance(c, str) else c for c in (expect_answer, grounded))
    declined = said_no_answer(answer)
    return F.when(expect_answer, ~declined & grounded).otherwise(declined)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


SEARCH_METRICS = ["precision_at_5", "recall_at_10", "mrr", "ndcg_at_10", "retrieval_latency_s"]
RAG_METRICS = {"confidence": "faithfulness_avg_confidence", "citation_accuracy": "citation_accuracy_rate"}
AGENT_METRICS = {
    "retrieval_success": "retrieval_success_rate", "grounded": "verification_success_rate",
    "task_completed": "task_completion_rate", "retry_count": "avg_retry_count", "ask_latency_s": "avg_ask_latency_s",
}


def summarize(rows: DataFrame) -> DataFrame:
    """One row of means and rates over the per-question rows; rows with an error are left out.

    Columns the run did not produce are skipped; missing values do not count; means of per-row
    values that were already rounded, rounded again.
    """
    have = rows.columns
    fine = F.col("error").isNull() if "error" in have else F.lit(True)
    out = [F.count(F.lit(1)).alias("total_queries"), F.count_if(~fine).alias("errored_queries")]
    names = {m: ("avg_" + m if m.endswith("_s") else m) for m in SEARCH_METRICS} | RAG_METRICS | AGENT_METRICS
    for source, name in names.items():
        if source in have:
            value = F.when(fine, F.col(source).cast("double"))
            out.append(F.coalesce(F.bround(F.avg(value), 3), F.lit(0.0)).alias(name))
    return rows.agg(*out)


def report_lines(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """One printable line per question."""
    have = set(rows.columns)
    flags = F.lit("retrieval-only")
    if "grounded" in have:
        flags = F.concat_ws(
            ", ",
            F.when(F.col("grounded"), "grounded").otherwise("UNGROUNDED"),
            F.when(F.coalesce("retry_count", F.lit(0)) > 0, F.concat(F.lit("retried x"), F.col("retry_count").cast("string"))),
            F.when(~F.coalesce("task_completed", F.lit(False)), "TASK-FAILED"),
        )
    line = F.format_string(
        "P@5=%.2f R@10=%.2f MRR=%.2f NDCG@10=%.2f [%s]  %s",
        "precision_at_5", "recall_at_10", "mrr", "ndcg_at_10", flags, "query",
    )
    if "error" in have:
        line = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR] "), "query", F.lit(": "), "error")).otherwise(line)
    return rows.select(key, line.alias("line"))
