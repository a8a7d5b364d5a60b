"""Answer chain steps over tables of questions: rewrite, context, citations, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import NO_ANSWER_TEXT, index_terms, word_count

# A sentence with citation markers, one marker, and a verdict line.
CITED_SENTENCE = r"[^.!?\n]*\[\d+\][^.!?\n]*[.!?]?"
MARKER = r"\[\d+\]"
VERDICT_LINE = r"(?i)^\s*(\d+)\s*:\s*(SUPPORTED|UNSUPPORTED)\s*-?\s*(.*)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rewrite_query(query: Column | str, keyword: str) -> Column:
    """Trimmed question; one of at most two words gets the product keyword appended."""
    q = _strip(_col(query))
    return F.when(word_count(q) <= 2, F.concat(q, F.lit(f" {keyword}"))).otherwise(q) if keyword else q


def parse_variants(reply: Column | str, fallback: Column | str, n: int) -> Column:
    """First ``n`` non-blank reply lines without list marks; the fallback if there are none."""
    lines = F.filter(F.split(_col(reply), r"\r\n|\r|\n"), lambda x: _strip(x) != "")
    cleaned = F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\-* \t]+|[\-* \t]+$", "")), 1, n)
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(F.array(_col(fallback)))


def gather_passages(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Passages of each question in rank order (at most the rerank size per question)."""
    parts = [c for c in ("rank", "doc_id", "url", "title", "section", "content", "rerank_score") if c in hits.columns]
    return hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("passages"))


def build_context(passages: Column | str) -> Column:
    """Numbered passages with their title and section, as the answer model reads them."""
    block = lambda p, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.coalesce(p["title"], F.lit("")), F.lit(" — "),
        F.coalesce(p["section"], F.lit("")), F.lit(")\n"), p["content"],
    )
    return F.array_join(F.transform(_col(passages), block), "\n\n")


def build_citations(passages: Column | str) -> Column:
    """One citation per passage, used or not: marker, URL, title, section."""
    return F.transform(
        _col(passages),
        lambda p, i: F.struct(
            F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("marker"),
            p["url"].alias("url"), p["title"].alias("title"), p["section"].alias("section"),
        ),
    )


def extractive_answer(passages: Column | str) -> Column:
    """Model-free default answer: first sentence of every passage with its marker."""
    sentence = lambda p: _strip(F.regexp_extract(p["content"], r"^\s*([^.!?\n]+)", 1))
    lines = F.transform(_col(passages), lambda p, i: F.concat(sentence(p), F.lit(" ["), (i + 1).cast("string"), F.lit("].")))
    return F.when(F.size(_col(passages)) > 0, F.array_join(lines, " ")).otherwise(NO_ANSWER_TEXT)


def markers_in(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(MARKER), F.lit(0))


def cited_sentences(answer: Column | str) -> Column:
    """``array<struct<sentence,markers>>`` of every sentence that cites something."""
    found = F.regexp_extract_all(_col(answer), F.lit(CITED_SENTENCE), F.lit(0))
    return F.transform(found, lambda s: F.struct(_strip(s).alias("sentence"), markers_in(s).alias("markers")))


def claims_with_evidence(sentences: Column, passages: Column, max_chars: int | None = None) -> Column:
    """Add the evidence text to every cited sentence (markers pair with passages by position)."""

    def evidence(markers: Column) -> Column:
        texts = F.transform(markers, lambda m: F.coalesce(F.get(passages, _marker_index(m))["content"], F.lit("")))
        joined = F.array_join(texts, "\n---\n")
        return F.substring(joined, 1, max_chars) if max_chars else joined

    return F.transform(
        sentences,
        lambda s: F.struct(s["sentence"].alias("sentence"), s["markers"].alias("markers"),
                           evidence(s["markers"]).alias("evidence")),
    )


def _marker_index(marker: Column) -> Column:
    digits = F.regexp_extract(marker, r"\d+", 0)
    return F.when((F.length(digits) <= 9), digits.try_cast("int") - 1)


def overlap_verdicts(claims: Column, threshold: float = 0.5) -> Column:
    """Model-free default fact check, in the reply format of the model: ``N: SUPPORTED``.

    A claim counts as supported when its evidence holds at least ``threshold`` of its terms.
    """

    def line(c: Column, i: Column) -> Column:
        terms = F.array_distinct(index_terms(F.regexp_replace(c["sentence"], MARKER, "")))
        share = F.size(F.array_intersect(terms, index_terms(c["evidence"]))) / F.greatest(F.size(terms), F.lit(1))
        verdict = F.when(share >= threshold, "SUPPORTED").otherwise("UNSUPPORTED - too few shared terms")
        return F.concat((i + 1).cast("string"), F.lit(": "), verdict)

    return F.array_join(F.transform(claims, line), "\n")


def parse_verdicts(reply: Column | str) -> Column:
    """``map<number, struct<supported,reason>>``; the last line of a number wins."""
    lines = F.filter(F.split(F.coalesce(_col(reply), F.lit("")), r"\r\n|\r|\n"), lambda x: x.rlike(VERDICT_LINE))
    number = lambda x: F.regexp_extract(x, VERDICT_LINE, 1)
    entry = lambda x: F.struct(
        number(x).alias("number"),
        F.struct(
            (F.upper(F.regexp_extract(x, VERDICT_LINE, 2)) == "SUPPORTED").alias("supported"),
            _strip(F.regexp_extract(x, VERDICT_LINE, 3)).alias("reason"),
        ).alias("verdict"),
    )

    def last_per_number(entries: Column) -> Column:
        later = lambda i: F.slice(entries, i + 2, F.size(entries))
        kept = F.filter(entries, lambda e, i: ~F.exists(later(i), lambda o: o["number"] == e["number"]))
        return F.map_from_entries(kept)

    return let(F.transform(lines, entry), last_per_number)


def judge_claims(claims: Column, verdicts: Column) -> Column:
    """Claims with ``supported, reason``; a claim without a readable verdict passes."""

    def judged(c: Column, i: Column, by_number: Column) -> Column:
        verdict = F.try_element_at(by_number, (i + 1).cast("string"))
        return F.struct(
            c["sentence"].alias("claim"), c["markers"].alias("citations"),
            F.coalesce(verdict["supported"], F.lit(True)).alias("supported"),
            F.coalesce(verdict["reason"], F.lit("")).alias("reason"),
        )

    return let(verdicts, lambda m: F.transform(claims, lambda c, i: judged(c, i, m)))


def verification(answer: Column | str, citations: Column | str, checks: Column) -> Column:
    """Verdict on an answer: marker check, unsupported claims, groundedness, confidence.

    ``checks`` are judged claims (empty when no fact check ran); they only count when every
    marker used in the answer exists.
    """
    valid = F.transform(_col(citations), lambda c: c["marker"])
    used = F.array_sort(F.array_distinct(markers_in(answer)))

    def judge(m: Column) -> Column:
        has_markers = F.size(m["used"]) > 0
        markers_ok = has_markers & (F.size(m["unknown"]) == 0)
        counted = F.when(markers_ok, m["checks"]).otherwise(F.slice(m["checks"], 1, 0))
        return let(
            F.struct(
                m["used"].alias("used"), m["unknown"].alias("unknown"), markers_ok.alias("ok"), has_markers.alias("any"),
                F.size(counted).alias("n"), F.filter(counted, lambda c: ~c["supported"]).alias("bad"),
            ),
            verdict,
        )

    def verdict(v: Column) -> Column:
        share = F.bround(1 - F.size(v["bad"]) / F.greatest(v["n"], F.lit(1)), 2)
        confidence = F.when(~v["ok"], F.when(v["any"], 0.5).otherwise(0.2)).when(v["n"] > 0, share).otherwise(1.0)
        return F.struct(
            (v["ok"] & (F.size(v["bad"]) == 0)).alias("grounded"),
            v["used"].alias("citations_used"),
            v["unknown"].alias("unsupported_citations"),
            F.transform(v["bad"], lambda c: F.struct(c["claim"].alias("claim"), c["citations"].alias("citations"),
                                                     c["reason"].alias("reason"))).alias("unsupported_claims"),
            confidence.alias("confidence"),
        )

    markers = let(used, lambda u: F.struct(u.alias("used"), F.array_except(u, valid).alias("unknown"), checks.alias("checks")))
    return let(markers, judge)


def wants_retry(retry_count: Column | str, n_reranked: Column, grounded: Column, max_retries: int) -> Column:
    """Another round when none is used up yet and the answer is empty-handed or ungrounded."""
    return (_col(retry_count) < max_retries) & ((n_reranked == 0) | ~F.coalesce(grounded, F.lit(False)))
