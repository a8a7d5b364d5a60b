import math

import pytest
from pyspark.sql import functions as F
from siltstone.config import AnswerConfig
from siltstone.functions.text import NO_ANSWER_TEXT
from siltstone.operators import answer as A
from siltstone.operators import evaluate as E
from siltstone.plans.engine import Engine

def five():
    return F.transform(F.array(*[F.lit(f"[{i}]") for i in range(1, 6)]), lambda m: F.struct(m.alias("marker")))


@pytest.mark.parametrize("q,expected", [(" what now ", "what now Kit"), ("one two three", "one two three"), ("x", "x Kit")])
def test_rewrite(one, q, expected):
    assert one(A.rewrite_query("q", "Kit"), q=q) == expected


def test_variants(one):
    assert one(A.parse_variants("r", F.lit("f"), 3), r="- a\n\n* b \n\t\nc\nd") == ["a", "b", "c"]
    assert one(A.parse_variants("r", F.lit("f"), 3), r=" \n") == ["f"]


def test_cited_sentences(one):
    got = one(A.cited_sentences("t"), t="Plain. One [1][2]! Two\nThree [10] here")
    assert [(s.sentence, s.markers) for s in got] == [("One [1][2]!", ["[1]", "[2]"]), ("Three [10] here", ["[10]"])]


def judged(one, text, reply):
    checks = A.judge_claims(A.cited_sentences("t"), A.parse_verdicts("r"))
    return one(A.verification("t", five(), checks), t=text, r=reply)


def test_confidence_levels(one):
    ok = judged(one, "A [1]. B [2]. C [3].", "1: SUPPORTED\n2: unsupported - wrong number\n3: ???")
    assert (ok.grounded, ok.confidence) == (False, 0.67)
    assert [(c.claim, c.reason) for c in ok.unsupported_claims] == [("B [2].", "wrong number")]
    unknown = judged(one, "A [1] and [9].", "1: UNSUPPORTED")
    assert (unknown.grounded, unknown.confidence, unknown.unsupported_citations, unknown.unsupported_claims) == (False, 0.5, ["[9]"], [])
    assert judged(one, NO_ANSWER_TEXT, "").confidence == 0.2
    fine = judged(one, "A [1].", "no verdict at all")
    assert (fine.grounded, fine.confidence) == (True, 1.0)


def test_evidence_pairs_by_position_and_can_be_cut(spark):
    df = spark.createDataFrame([("x [2][7].", [("first",), ("second",)])], "t string, p array<struct<content:string>>")
    row = df.select(A.claims_with_evidence(A.cited_sentences("t"), F.col("p"))[0]["evidence"].alias("whole"),
                    A.claims_with_evidence(A.cited_sentences("t"), F.col("p"), 3)[0]["evidence"].alias("cut")).first()
    assert (row.whole, row.cut) == ("second\n---\n", "sec")


@pytest.mark.parametrize("count,n,grounded,expected", [(0, 0, True, True), (0, 5, False, True), (0, 5, True, False), (1, 0, False, False)])
def test_retry(one, count, n, grounded, expected):
    assert one(A.wants_retry(F.lit(count), F.lit(n), F.lit(grounded), 1), x="") is expected


def test_metrics_by_hand(spark):
    urls = ["https://x/a/#s", "https://x/a?v", "https://x/b", "https://x/c"]
    hits = spark.createDataFrame([(1, i + 1, u) for i, u in enumerate(urls)] + [(2, 1, "https://x/z"), (3, 1, "https://x/z")], "query_id int, rank int, url string")
    cases = spark.createDataFrame([(1, ["https://x/b", "https://x/c/", "https://x/none"]), (2, []), (3, ["https://x/q"])], "query_id int, expected_urls array<string>")
    rows = E.retrieval_metrics(E.ranked_urls(hits), E.expected_urls(cases), cases.select("query_id"))
    got = {r.query_id: r for r in E.rounded(rows, ["precision_at_5", "recall_at_10", "mrr", "ndcg_at_10"]).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert tuple(got[1])[1:] == (0.4, 0.667, 0.5, round(dcg / ideal, 3))
    assert tuple(got[2])[1:] == (0.0, 1.0, 0.0, 1.0)
    assert tuple(got[3])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_summary_skips_errors_and_missing_values(spark):
    rows = spark.createDataFrame([("a", 0.333, True, None), ("b", 0.334, None, None), ("c", None, None, "boom")], "query string, mrr double, grounded boolean, error string")
    row = E.summarize(rows).first()
    assert (row.total_queries, row.errored_queries, row.mrr, row.verification_success_rate) == (3, 1, 0.334, 1.0)


def test_report_lines(spark):
    rows = spark.createDataFrame([(1, "q?", 0.2, 1.0, 0.5, 0.63, False, 1, True)],
                                 "query_id int, query string, precision_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double, grounded boolean, retry_count int, task_completed boolean")
    assert E.report_lines(rows).first().line == "P@5=0.20 R@10=1.00 MRR=0.50 NDCG@10=0.63 [UNGROUNDED, retried x1]  q?"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("d1", "https://kb/a", "Rotate keys", "Rotate the access key every ninety days. Use the console.", "x"),
            ("d2", "https://kb/b", "Install", "Install the agent with the package manager. Restart afterwards.", "x"),
            ("d3", "https://kb/c", "Billing", "Invoices are sent monthly. Pay by card.", "x")]
    docs = spark.createDataFrame(rows, "id string, url string, title string, text string, content_hash string")
    from siltstone.operators.documents import as_documents

    return as_documents(docs)


def test_engine_answers_and_verifies(spark, corpus):
    engine = Engine(spark, AnswerConfig(product_keyword="Kit")).index(corpus)
    questions = spark.createDataFrame([(1, "how often must I rotate the access key"), (2, "invoices"), (3, " ")], "query_id int, query string")
    answers = engine.ask(questions)
    got = {r.query_id: r for r in answers.collect()}
    assert set(got) == {1, 2} and got[2].rewritten_query == "invoices Kit"
    assert got[1].answer.startswith("Rotate the access key every ninety days [1].")
    assert got[1].citations[0].url == "https://kb/a" and got[1].verification.grounded and got[1].retry_count == 0
    nodes = [r.node for r in engine.trace(answers).filter("query_id = 1").orderBy("step").collect()]
    assert nodes == ["rewrite", "search", "rerank", "answer", "check"]


def test_engine_retries_ungrounded_answers_once(spark, corpus):
    engine = Engine(spark, answer=lambda q, c, p: F.lit("made up [9]."), vary=lambda q: F.lit("- rotate key\n- key age")).index(corpus)
    row = engine.ask(spark.createDataFrame([(1, "when do keys expire please")], "query_id int, query string")).first()
    assert (row.retry_count, row.query_variants, row.verification.confidence) == (1, ["rotate key", "key age"], 0.5)


def test_engine_evaluates_golden_cases(spark, corpus):
    engine = Engine(spark).index(corpus)
    cases = spark.createDataFrame([(1, "rotate access key days", ["https://kb/a"], True), (2, "zebra quantum", [], False)],
                                  "query_id int, query string, expected_urls array<string>, expect_answer boolean")
    rows = engine.evaluate(cases, 2)
    got = {r.query_id: r for r in rows.collect()}
    assert (got[1].mrr, got[1].recall_at_10, got[1].task_completed) == (1.0, 1.0, True)
    summary = E.summarize(rows).first()
    assert summary.total_queries == 2 and summary.retrieval_success_rate == 1.0
