"""Answer chain steps over conversations and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER_TEXT
from ..operators import answer as A
from ..operators import evaluate as E
from ..session import materialise
from .catalog import query, table
from .report_queries import SQL_WORDS
from .search_queries import SQL_RERANKED, reranked

SQL_TALK = """
talk AS (SELECT conv_id, turn, role, text, regexp_replace(text, '([a-z])\\.', '\\1 [' || (turn % 7 + 1) || '].', 'g') AS answer FROM conversations)"""


def talk(spark, sf_dir):
    """Conversations whose sentences cite a passage numbered by the turn."""
    marker = F.concat(F.lit("$1 ["), (F.col("turn") % 7 + 1).cast("string"), F.lit("]."))
    return table(spark, sf_dir, "conversations").withColumn("answer", F.regexp_replace(F.col("text"), F.lit(r"([a-z])\."), marker))


@query(
    f"""WITH q AS (SELECT conv_id, turn, ' ' || text || ' ' AS q, role FROM conversations)
SELECT conv_id, turn, CASE WHEN {SQL_WORDS.format('q')} <= 2 THEN trim(q, ' ' || chr(10)) || ' Manual' ELSE trim(q, ' ' || chr(10)) END AS rewritten,
  role || ' Manual' AS short FROM q"""
)
def query_rewrite(spark, sf_dir):
    """Whole texts as questions, and the role as a question of one word."""
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", A.rewrite_query(padded, "Manual").alias("rewritten"), A.rewrite_query("role", "Manual").alias("short")
    )


@query(
    """WITH r AS (SELECT conv_id, turn, '- ' || replace(text, chr(10), chr(10) || chr(10) || '* ') AS reply FROM conversations),
 l AS (SELECT conv_id, turn, list_transform(list_filter(string_split(reply, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x, '-* ' || chr(9))) AS v FROM r)
SELECT conv_id, turn, array_to_string(CASE WHEN len(v) = 0 THEN ['(none)'] ELSE v[1:3] END, '|') AS variants FROM l"""
)
def variant_parse(spark, sf_dir):
    reply = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n\n* ")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(A.parse_variants(reply, F.lit("(none)"), 3), "|").alias("variants")
    )


def passages(spark, sf_dir):
    hits = reranked(spark, sf_dir).withColumn("url", F.concat(F.lit("https://kb.example.com/"), F.col("doc_id").cast("string")))
    return A.gather_passages(hits)


SQL_PASSAGES = SQL_RERANKED + ", ps AS (SELECT *, 'https://kb.example.com/' || doc_id AS url FROM rr)"


@query(
    "WITH " + SQL_PASSAGES + """ SELECT query_id, md5(string_agg('[' || rank || '] (' || title || ' — ' || section || ')' || chr(10) || content,
  chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM ps GROUP BY query_id"""
)
def context_build(spark, sf_dir):
    return passages(spark, sf_dir).select("query_id", F.md5(A.build_context("passages")).alias("context_md5"))


@query("WITH " + SQL_PASSAGES + " SELECT query_id, '[' || rank || ']' AS marker, url, title, section FROM ps")
def citations_build(spark, sf_dir):
    return passages(spark, sf_dir).select("query_id", F.inline(A.build_citations("passages")))


SQL_CITED = "regexp_extract_all(answer, '[^.!?\\n]*\\[\\d+\\][^.!?\\n]*[.!?]?')"


@query(
    "WITH " + SQL_TALK + f""", s AS (SELECT conv_id, turn, unnest({SQL_CITED}) AS s, generate_subscripts({SQL_CITED}, 1) - 1 AS pos FROM talk)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, trim(s) AS sentence, array_to_string(regexp_extract_all(s, '\\[\\d+\\]'), ' ') AS markers FROM s"""
)
def cited_sentences(spark, sf_dir):
    rows = talk(spark, sf_dir).select("conv_id", "turn", F.posexplode(A.cited_sentences("answer")).alias("pos", "s"))
    return rows.select("conv_id", "turn", "pos", "s.sentence", F.array_join("s.markers", " ").alias("markers"))


SQL_VERDICTS = """
reply AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '1: SUPPORTED' || chr(10) || ' 2 : unsupported - ' || left(md5(text), 6) || chr(10) || '3: maybe'
   WHEN 1 THEN '1: UNSUPPORTED not there' || chr(10) || '1: Supported' WHEN 2 THEN 'I cannot tell' ELSE text END AS reply FROM conversations)"""


def verdict_replies(spark, sf_dir):
    kind = F.col("turn") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("1: SUPPORTED\n 2 : unsupported - "), F.substring(F.md5("text"), 1, 6), F.lit("\n3: maybe")))
        .when(kind == 1, "1: UNSUPPORTED not there\n1: Supported").when(kind == 2, "I cannot tell").otherwise(F.col("text"))
    )
    return talk(spark, sf_dir).withColumn("reply", reply)


@query(
    "WITH " + SQL_VERDICTS + """, n(i) AS (VALUES (1), (2), (3))
SELECT conv_id, turn, i AS claim, CASE WHEN turn % 4 = 0 AND i = 2 THEN FALSE ELSE TRUE END AS supported,
  CASE WHEN turn % 4 = 0 AND i = 2 THEN regexp_extract(reply, 'unsupported - (.*)', 1) ELSE '' END AS reason FROM reply, n"""
)
def verdict_parse(spark, sf_dir):
    claims = F.transform(F.array(F.lit("a"), F.lit("b"), F.lit("c")),
                         lambda s: F.struct(s.alias("sentence"), F.array(F.lit("[1]")).alias("markers")))
    judged = A.judge_claims(claims, A.parse_verdicts("reply"))
    rows = verdict_replies(spark, sf_dir).select("conv_id", "turn", F.posexplode(judged).alias("i", "j"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).alias("claim"), "j.supported", "j.reason")


SQL_VERIFIED = (
    SQL_TALK + f""", v AS (SELECT conv_id, turn, answer, list_sort(list_distinct(regexp_extract_all(answer, '\\[\\d+\\]'))) AS used, len({SQL_CITED}) AS n FROM talk),
 w AS (SELECT *, list_filter(used, lambda m: m NOT IN ('[1]', '[2]', '[3]', '[4]', '[5]')) AS unknown FROM v),
 x AS (SELECT *, len(used) > 0 AND len(unknown) = 0 AS ok, CASE WHEN turn % 4 = 0 AND n >= 2 THEN 1 ELSE 0 END AS bad FROM w),
 ver AS (SELECT conv_id, turn, answer, used, unknown, ok AND bad = 0 AS grounded, CASE WHEN NOT ok THEN CASE WHEN len(used) > 0 THEN 0.5 ELSE 0.2 END
   ELSE round_even(1 - bad / n::DOUBLE, 2) END::DOUBLE AS confidence, CASE WHEN ok THEN bad ELSE 0 END AS bad FROM x)"""
)


def verified(spark, sf_dir):
    """Answers with five passages each, judged by the replies of :func:`verdict_replies`."""
    five = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("marker")))
    rows = verdict_replies(spark, sf_dir).withColumn("citations", five)
    rows = rows.withColumn("checks", A.judge_claims(A.cited_sentences("answer"), A.parse_verdicts("reply")))
    return rows.withColumn("v", A.verification("answer", "citations", F.col("checks")))


@query(
    "WITH " + SQL_VERIFIED + """ SELECT conv_id, turn, grounded, array_to_string(used, ' ') AS used, array_to_string(unknown, ' ') AS unknown,
  CAST(bad AS INTEGER) AS unsupported_claims, confidence FROM ver"""
)
def verify_citations(spark, sf_dir):
    return verified(spark, sf_dir).select(
        "conv_id", "turn", "v.grounded", F.array_join("v.citations_used", " ").alias("used"),
        F.array_join("v.unsupported_citations", " ").alias("unknown"), F.size("v.unsupported_claims").alias("unsupported_claims"),
        "v.confidence",
    )


@query("WITH " + SQL_VERIFIED + " SELECT conv_id, turn, turn % 2 < 1 AND (turn = 0 OR NOT grounded) AS retry FROM ver")
def retry_gate(spark, sf_dir):
    reranked_n = F.when(F.col("turn") == 0, 0).otherwise(5)
    return verified(spark, sf_dir).select(
        "conv_id", "turn", A.wants_retry(F.col("turn") % 2, reranked_n, F.col("v.grounded"), 1).alias("retry")
    )


@query(
    "WITH " + SQL_VERIFIED + f""" SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn % 5 = 4 ELSE turn % 5 <> 4 AND grounded END AS done FROM ver"""
)
def task_completion(spark, sf_dir):
    answer = F.when(F.col("turn") % 5 == 4, NO_ANSWER_TEXT).otherwise(F.col("answer"))
    return verified(spark, sf_dir).select(
        "conv_id", "turn", E.task_completed(F.col("turn") % 3 != 2, answer, F.col("v.grounded")).alias("done")
    )


@query()
def answer_questions(spark, sf_dir):
    """The whole answer chain for every benchmark question, with the model-free defaults."""
    from .engine import Engine
    from .search_queries import questions, search_docs

    docs = search_docs(spark, sf_dir, True).withColumns({
        "chunk_id": F.col("doc_id").cast("string"), "url": F.concat(F.lit("https://kb.example.com/"), F.col("doc_id").cast("string")),
    })
    engine = Engine(spark).with_chunks(materialise(docs.drop("doc_id"), "chunks"))
    return engine.ask(questions(spark, sf_dir)).select(
        "query_id", "rewritten_query", "answer", F.size("citations").alias("citations"), "verification.grounded",
        "verification.confidence", "retry_count",
    )


@query()
def answer_trace(spark, sf_dir):
    """One row per step of every question: node, label and a readable summary."""
    from .engine import Engine
    from .search_queries import questions, search_docs

    docs = search_docs(spark, sf_dir, True).withColumns({
        "chunk_id": F.col("doc_id").cast("string"), "url": F.concat(F.lit("https://kb.example.com/"), F.col("doc_id").cast("string")),
    })
    engine = Engine(spark).with_chunks(materialise(docs.drop("doc_id"), "chunks"))
    return engine.trace(engine.ask(questions(spark, sf_dir)))
