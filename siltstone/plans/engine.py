"""The facade: chunk, index, search, ask, profile and evaluate over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnswerConfig
from ..functions import vectors as V
from ..operators import answer as A
from ..operators import chunking as C
from ..operators import evaluate as E
from ..operators import search as S
from ..session import materialise, shared_path
from ..sources import tables

Model = Callable[..., Column]

#: Steps of an answer and what each of them does.
STEPS = {
    "rewrite": "Question as searched",
    "variants": "Further wordings tried after a failed check",
    "search": "Words and vectors, fused",
    "search_variants": "All wordings, fused once more",
    "rerank": "Passages scored against the question",
    "answer": "Text with citations",
    "check": "Claims held against their passages",
}


class Engine:
    """Search and answering over one chunk table.

    Models are column functions: ``embed(text)``, ``score(query, passage)``,
    ``answer(query, context, passages)``, ``vary(query)`` (reply lines) and ``judge(claims)``
    (reply lines). The defaults need no model; a real one is a ``pandas_udf``.
    """

    def __init__(
        self, spark: SparkSession, config: AnswerConfig | None = None, embed: Model = V.hashed_embedding,
        score: Model = S.lexical_overlap, answer: Model | None = None, vary: Model | None = None, judge: Model | None = None,
    ) -> None:
        self.spark, self.config = spark, config or AnswerConfig()
        self.embed, self.score = embed, score
        self.answer = answer or (lambda query, context, passages: A.extractive_answer(passages))
        self.vary = vary or _sentence_variants
        self.judge = judge or A.overlap_verdicts
        self.chunks: DataFrame | None = None
        self.terms: S.TextIndex | None = None

    # ---------------------------------------------------------------- index

    def with_chunks(self, chunks: DataFrame) -> Engine:
        """Use a chunk table that already has ``embedding``; its inverted index is written once, here."""
        self.chunks = chunks
        self.terms = S.write_index(chunks, shared_path(self.spark, "terms"), stem=self.config.stem)
        return self

    def open(self, path: str) -> Engine:
        """Use a stored index. Its inverted index stands beside the chunks and is written if it is missing."""
        version = tables.latest_version(self.spark, path)
        if version is None:
            raise FileNotFoundError(f"no index at {path}")
        self.chunks = tables.read_snapshot(self.spark, path)
        terms = f"{path}/terms-{'stem' if self.config.stem else 'plain'}-{version}"
        if tables.is_complete(self.spark, f"{terms}/fields"):
            self.terms = S.TextIndex(self.spark, terms, self.config.stem)
        else:
            self.terms = S.write_index(self.chunks, terms, stem=self.config.stem)
        return self

    def index(self, documents: DataFrame, path: str | None = None) -> Engine:
        """Chunk and embed documents; with ``path``, merge them into the stored index."""
        chunks = C.chunk_documents(documents)
        chunks = chunks.withColumn("embedding", self.embed(V.prefixed("content", self.config.embedding_model, False)))
        if path is None:
            return self.with_chunks(materialise(chunks, "index"))
        tables.merge_into(self.spark, path, chunks, S.merge_chunks)
        return self.open(path)

    # ---------------------------------------------------------------- search

    def _queries(self, queries: DataFrame, text: str = "query") -> DataFrame:
        model = V.prefixed(text, self.config.embedding_model, True)
        return queries.select("query_id", F.col(text).alias("query"), self.embed(model).alias("embedding"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hybrid hits with their chunk columns: ``query_id, rank, score, chunk_id, ...``."""
        if self.chunks is None:
            raise RuntimeError("no index: call index() or with_chunks() first")
        return self._with_chunks(self._hybrid(self._queries(queries), k))

    def _hybrid(self, queries: DataFrame, k: int) -> DataFrame:
        """Words from the inverted index, vectors from their column; texts are not read."""
        return S.hybrid_indexed(self.terms, self.chunks.select(F.col("chunk_id").alias("doc_id"), "embedding"), queries, k)

    def _with_chunks(self, hits: DataFrame) -> DataFrame:
        # Written first: its true size decides how the chunk table is probed.
        hits = materialise(hits, "hits").withColumnRenamed("doc_id", "chunk_id")
        return self.chunks.drop("embedding").join(hits, "chunk_id")

    # ---------------------------------------------------------------- answering

    def _answer_round(self, state: DataFrame, hits: DataFrame) -> DataFrame:
        """Rerank, answer and verify. ``state`` has one row per question."""
        c = self.config
        pairs = hits.join(state.select("query_id", "query"), "query_id")
        best = S.rerank_topk(pairs.withColumnRenamed("chunk_id", "doc_id"), self.score(F.col("query"), F.col("content")), c.rerank_top_k)
        found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
        rows = state.join(found, "query_id", "left").join(A.gather_passages(best), "query_id", "left")
        empty = F.slice("passages", 1, 0)
        rows = rows.withColumn("passages", F.coalesce("passages", empty, F.array().cast(_passage_type(best))))
        rows = rows.withColumn("context", A.build_context("passages")).withColumn(
            "answer", F.when(F.size("passages") > 0, self.answer(F.col("query"), F.col("context"), F.col("passages")))
            .otherwise(A.NO_ANSWER_TEXT)
        )
        rows = rows.withColumn("citations", A.build_citations("passages"))
        checks = F.array().cast("array<struct<claim:string,citations:array<string>,supported:boolean,reason:string>>")
        if c.semantic_verification:
            claims = A.claims_with_evidence(A.cited_sentences("answer"), F.col("passages"), c.evidence_max_chars)
            rows = rows.withColumn("claims", claims).withColumn("verdicts", A.parse_verdicts(self.judge(F.col("claims"))))
            checks = A.judge_claims(F.col("claims"), F.col("verdicts"))
        rows = rows.withColumn("checks", checks).withColumn("verification", A.verification("answer", "citations", F.col("checks")))
        return rows.drop("claims", "verdicts", "checks", "context")

    def ask(self, queries: DataFrame) -> DataFrame:
        """Answer every question (``query_id, query``); one row each.

        The corrective second round runs as one more pass over the questions that failed.
        """
        if self.chunks is None:
            raise RuntimeError("no index: call index() or with_chunks() first")
        c = self.config
        state = queries.select(
            "query_id", "query", A.rewrite_query("query", c.product_keyword).alias("rewritten_query"),
            F.array().cast("array<string>").alias("query_variants"), F.lit(0).alias("retry_count"),
        ).filter(F.trim("query") != "")
        state = materialise(state, "questions")
        hits = self._with_chunks(self._hybrid(self._queries(state, "rewritten_query"), c.retrieval_top_k))
        done = materialise(self._answer_round(state, hits), "answers")
        finished = None
        for _ in range(c.max_retries):
            again = A.wants_retry("retry_count", F.size("passages"), F.col("verification.grounded"), c.max_retries)
            settled, failed = done.filter(~again), done.filter(again)
            finished = settled if finished is None else finished.unionByName(settled)
            if failed.isEmpty():
                return finished
            reply = self.vary(F.col("query"))
            state = materialise(
                failed.select(
                    "query_id", "query", "rewritten_query",
                    A.parse_variants(reply, "rewritten_query", c.multi_query_variants).alias("query_variants"),
                    (F.col("retry_count") + 1).alias("retry_count"),
                ),
                "retries",
            )
            forms = F.concat(F.array("rewritten_query"), "query_variants")
            variants = state.select("query_id", F.posexplode(forms).alias("variant", "query")).withColumn(
                "embedding", self.embed(V.prefixed("query", c.embedding_model, True))
            )
            hits = self._with_chunks(S.fused_variants(variants, c.retrieval_top_k, self._hybrid))
            done = materialise(self._answer_round(state, hits), "answers")
        return done if finished is None else finished.unionByName(done)

    def trace(self, answers: DataFrame) -> DataFrame:
        """The steps behind each answer: ``query_id, step, node, label, amount`` (how many, or how sure) and ``detail``."""
        found = F.coalesce("n_retrieved", F.lit(0)).cast("double")
        kept = F.size("passages").cast("double")
        best = F.array_max(F.transform("passages", lambda p: p["rerank_score"])).cast("double")
        retried = F.col("retry_count") > 0
        steps = [
            ("rewrite", F.col("rewritten_query"), F.lit(None), F.lit(True)),
            ("variants", F.array_join("query_variants", "; "), F.size("query_variants"), retried),
            ("search", F.lit(None), found, ~retried),
            ("search_variants", F.lit(None), found, retried),
            ("rerank", F.concat(F.lit("best score "), F.coalesce(F.format_number(best, 3), F.lit("none"))), kept, F.lit(True)),
            ("answer", F.concat(F.length("answer").cast("string"), F.lit(" characters")), F.size("citations"), F.lit(True)),
            ("check", F.when(F.col("verification.grounded"), "every claim is supported").otherwise("some claim lacks support"),
             F.col("verification.confidence"), F.lit(True)),
        ]
        packed = F.array(*[
            F.struct(F.lit(node).alias("node"), F.lit(STEPS[node]).alias("label"), detail.cast("string").alias("detail"),
                     amount.cast("double").alias("amount"), shown.alias("shown"))
            for node, detail, amount, shown in steps
        ])
        rows = answers.select("query_id", F.posexplode(F.filter(packed, lambda s: s["shown"])).alias("step", "s"))
        return rows.select("query_id", "step", "s.node", "s.label", "s.amount", "s.detail")

    # ---------------------------------------------------------------- evaluation

    def evaluate(self, cases: DataFrame, k: int = 10, with_answers: bool = True) -> DataFrame:
        """Per-question metrics of golden cases (``query_id, query, expected_urls, expect_answer``)."""
        hits = self.search(cases.select("query_id", "query"), k)
        ranked = E.ranked_urls(hits)
        n_hits = hits.groupBy("query_id").agg(F.lit(True).alias("_any"))
        rows = E.retrieval_metrics(ranked, E.expected_urls(cases), cases)
        rows = E.rounded(rows, ["precision_at_5", "recall_at_10", "mrr", "ndcg_at_10"])
        rows = rows.join(n_hits, "query_id", "left").withColumn("retrieval_success", F.coalesce("_any", F.lit(False))).drop("_any")
        if not with_answers:
            return rows
        answers = self.ask(cases.select("query_id", "query")).select(
            "query_id", "answer", "retry_count", "verification.grounded", "verification.confidence",
            (F.size("verification.unsupported_citations") == 0).alias("citation_accuracy"),
        )
        rows = rows.join(answers, "query_id", "left")
        return rows.withColumn("said_no_answer", E.said_no_answer("answer")).withColumn(
            "task_completed", E.task_completed("expect_answer", "answer", "grounded")
        )

    def describe(self) -> dict[str, object]:
        """Effective settings (what a configuration endpoint would show)."""
        return asdict(self.config)


def _sentence_variants(query: Column) -> Column:
    """Model-free variants: the sentences of the question, one per line."""
    return F.regexp_replace(query, r"[.!?,;]+\s*", "\n")


def _passage_type(hits: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    parts = [c for c in ("rank", "doc_id", "url", "title", "section", "content", "rerank_score") if c in kinds]
    return "array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in parts) + ">>"
