"""Corpus report over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators import profile as P

from .catalog import query, table
from .url_queries import sql_host

SQL_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.REPORT_STOPWORDS)
SQL_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9''\\-]{{2,}}'), lambda w: w NOT IN (" + SQL_STOP + "))"
SQL_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
SQL_URL_SECTION = "COALESCE(NULLIF(regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1), ''), '(home)')"


SQL_CORPUS = f"""
corpus AS (
  SELECT d.doc_id, 'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id AS url, d.text, d.lang AS language,
    split_part(d.text, chr(10), 1) AS title, CAST({SQL_WORDS.format('d.text')} AS INTEGER) AS word_count,
    CASE WHEN COALESCE(l.toxic, 0) = 1 OR d.source = 'src3' THEN 'linked_document' ELSE 'web_page' END AS source_type,
    CASE WHEN d.lang = 'en' THEN 'application/pdf' WHEN d.lang = 'fr' THEN 'text/csv' ELSE 'application/msword' END AS content_type,
    COALESCE(l.quality = 0, FALSE) AS needs_extraction
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def corpus(spark, sf_dir):
    """Documents and labels read as a crawled corpus of pages and linked files."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lang = F.col("lang")
    asset = (F.coalesce("toxic", F.lit(0)) == 1) | (F.col("source") == "src3")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "text", lang.alias("language"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        T.word_count("text").alias("word_count"),
        F.when(asset, "linked_document").otherwise("web_page").alias("source_type"),
        F.when(lang == "en", "application/pdf").when(lang == "fr", "text/csv").otherwise("application/msword").alias("content_type"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_extraction"),
    )


def web_pages(spark, sf_dir):
    return corpus(spark, sf_dir).filter("source_type = 'web_page'")


@query(
    "WITH " + SQL_CORPUS + """ SELECT COUNT(*) AS documents, COUNT(*) FILTER (source_type = 'web_page') AS pages,
  COUNT(*) FILTER (source_type = 'linked_document') AS assets, CAST(SUM(word_count) FILTER (source_type = 'web_page') AS BIGINT) AS total_words,
  CAST(median(word_count) FILTER (source_type = 'web_page') AS DOUBLE) AS median_words, MAX(word_count) FILTER (source_type = 'web_page') AS max_words,
  MIN(word_count) FILTER (source_type = 'web_page') AS min_words, COUNT(*) FILTER (source_type = 'web_page' AND word_count < 100) AS thin_pages FROM corpus"""
)
def corpus_summary(spark, sf_dir):
    return P.corpus_summary(corpus(spark, sf_dir).select("source_type", "word_count"))


@query(
    "WITH " + SQL_CORPUS + """ SELECT COALESCE(NULLIF(language, ''), '(unset)') AS language, COUNT(*) AS n FROM corpus
WHERE source_type = 'web_page' GROUP BY 1 ORDER BY n DESC, language LIMIT 5"""
)
def lang_counts(spark, sf_dir):
    return P.language_counts(web_pages(spark, sf_dir))


@query(
    f"""WITH s AS (SELECT {SQL_URL_SECTION} AS section, COUNT(*) AS n FROM pages GROUP BY 1)
SELECT section, n, ROUND(n * 100.0 / (SELECT COUNT(*) FROM pages), 6)::DOUBLE AS pct FROM s ORDER BY n DESC, section LIMIT 25"""
)
def section_share(spark, sf_dir):
    return P.section_shares(table(spark, sf_dir, "pages"))


SQL_DATES = """
dated AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00')
   WHEN 'F' THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') ELSE 'last ' || strftime(o_orderdate, '%A') END AS modified_at,
   CASE WHEN o_orderpriority LIKE '1%' THEN '' END AS published_at, o_orderdate FROM orders)"""


def dated_pages(spark, sf_dir):
    """Orders read as pages whose dates come in ISO form, HTTP form, or not at all."""
    at, status = F.col("o_orderdate"), F.col("o_orderstatus")
    modified = (
        F.when(status == "O", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .when(status == "F", F.date_format(at, "E, dd MMM yyyy HH:mm:ss 'GMT'"))
        .otherwise(F.concat(F.lit("last "), F.date_format(at, "EEEE")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", modified.alias("modified_at"),
        F.when(F.col("o_orderpriority").startswith("1"), "").alias("published_at"),
    )


@query(
    "WITH " + SQL_DATES + """ SELECT CASE WHEN regexp_matches(modified_at, '^[0-9]{4}') OR modified_at LIKE '%GMT' THEN strftime(o_orderdate, '%Y')
  ELSE '(unknown)' END AS year, COUNT(*) AS n FROM dated GROUP BY 1 ORDER BY year DESC LIMIT 12"""
)
def freshness_year(spark, sf_dir):
    return P.freshness(dated_pages(spark, sf_dir))


@query(
    f"""SELECT COALESCE(NULLIF({sql_host('url')}, ''), '?') AS host, COUNT(*) AS n,
  ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM pages), 6)::DOUBLE AS pct FROM pages GROUP BY 1"""
)
def host_share(spark, sf_dir):
    return P.host_shares(table(spark, sf_dir, "pages"))


@query(f"""SELECT doc_id, array_to_string({SQL_TERMS.format('text')}, ' ') AS terms FROM documents""")
def tokenize_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.report_terms("text"), " ").alias("terms"))


@query(
    f"""WITH t AS (SELECT page_id, replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '&copy;', '©') AS title,
    replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&') AS h1 FROM pages),
 w AS (SELECT {SQL_TERMS.format("title || ' . ' || h1")} AS w FROM t),
 b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w)
SELECT phrase, COUNT(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, phrase LIMIT 25"""
)
def bigram_topk(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select(H.parsed_page("html").alias("p"))
    return P.topic_counts(page.select("p.title", "p.headings"))


@query(
    f"""WITH t AS (SELECT unnest(list_distinct({SQL_TERMS.format('text')})) AS term FROM documents)
SELECT term, COUNT(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 25"""
)
def term_df_topk(spark, sf_dir):
    return P.term_frequencies(table(spark, sf_dir, "documents"))


@query(
    "WITH " + SQL_CORPUS + """ SELECT url, word_count, title FROM corpus WHERE source_type = 'web_page' ORDER BY word_count DESC, url LIMIT 10"""
)
def largest_docs(spark, sf_dir):
    return P.largest(web_pages(spark, sf_dir).select("url", "word_count", "title"))


@query(
    "WITH " + SQL_CORPUS + f""", k AS (SELECT *, {SQL_URL_SECTION} AS section FROM corpus WHERE source_type = 'web_page'),
 top AS (SELECT section FROM k GROUP BY 1 ORDER BY COUNT(*) DESC, section LIMIT 10),
 r AS (SELECT section, url, word_count, row_number() OVER (PARTITION BY section ORDER BY word_count DESC, url) AS rank FROM k WHERE section IN (SELECT section FROM top))
SELECT section, CAST(rank AS INTEGER) AS rank, url, word_count FROM r WHERE rank <= 5"""
)
def topk_per_section(spark, sf_dir):
    return P.samples_per_section(web_pages(spark, sf_dir).select("url", "word_count"))


@query(
    "WITH " + SQL_CORPUS + """ SELECT content_type, COUNT(*) AS n, COUNT(*) FILTER (needs_extraction) AS pending FROM corpus
WHERE source_type = 'linked_document' GROUP BY 1"""
)
def asset_types(spark, sf_dir):
    return P.asset_types(corpus(spark, sf_dir).filter("source_type = 'linked_document'"))


@query(
    f"""WITH s AS (SELECT {SQL_URL_SECTION} AS section, COUNT(*) AS n FROM pages GROUP BY 1)
SELECT section, n, repeat('#', greatest(1, CAST(round_even(n / (SELECT MAX(n) FROM s) * 28, 0) AS INTEGER))) AS bar FROM s"""
)
def histogram_bar(spark, sf_dir):
    from ..functions.urls import url_section

    return P.with_bars(P.counted(table(spark, sf_dir, "pages"), url_section("url"), "section"))
