"""Crawl state: hashes, duplicates, change detection, merges, outcome counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from .catalog import query, table
from .url_queries import SQL_RESPONSES, responses

SQL_DOC_URLS = """
docs AS (SELECT doc_id, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url, text,
   sha256(text) AS content_hash FROM documents)"""


def doc_urls(spark, sf_dir):
    """Documents as crawled pages: one URL and content hash each."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", url.alias("url"), "text", S.content_hash("text").alias("content_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 32) AS id FROM documents")
def content_hash(spark, sf_dir):
    digest = S.content_hash("text")
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("content_hash"), S.document_id(digest).alias("id"))


@query(
    "WITH " + SQL_DOC_URLS
    + """ SELECT doc_id, content_hash, text <> '' AND row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 AS is_duplicate FROM docs"""
)
def exact_dedup(spark, sf_dir):
    docs = doc_urls(spark, sf_dir).select("doc_id", "url", "content_hash")
    return S.mark_duplicates(docs, ["doc_id"]).select("doc_id", "content_hash", "is_duplicate")


@query(
    "WITH " + SQL_DOC_URLS
    + """, known AS (SELECT d.url, d.content_hash FROM docs d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1)
SELECT doc_id, text <> '' AND (row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1
  OR EXISTS (SELECT 1 FROM known k WHERE k.content_hash = docs.content_hash AND k.url <> docs.url)) AS is_duplicate FROM docs"""
)
def dedup_against_state(spark, sf_dir):
    docs = doc_urls(spark, sf_dir).select("doc_id", "url", "content_hash")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    known = docs.join(good, "doc_id").select("url", "content_hash")
    return S.mark_duplicates(docs, ["doc_id"], known).select("doc_id", "is_duplicate")


@query(
    "WITH " + SQL_DOC_URLS
    + """ SELECT d.doc_id, d.url, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 THEN 'unchanged' ELSE 'changed' END AS change
FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def change_detect(spark, sf_dir):
    docs = doc_urls(spark, sf_dir).select("doc_id", "url", "content_hash")
    earlier = F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.sha2("content_hash", 256))
    known = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("url", earlier.alias("content_hash"))
    return S.detect_changes(docs, known).select("doc_id", "url", "change")


SQL_SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    f"""WITH log AS (SELECT 'https://users.example.com/' || user_id AS url, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t,
    ts < {SQL_SPLIT} AS is_old, event_type, CAST(floor(value) AS INTEGER) AS status, md5(props) AS content_hash FROM events),
 old AS (SELECT url, arg_max(status, event_id) AS status, arg_max(content_hash, event_id) AS content_hash, min(t) AS first_seen, max(t) AS last_crawled
   FROM log WHERE is_old GROUP BY url),
 fresh AS (SELECT url, min(t) AS first_seen, max(t) AS last_crawled, arg_max(status, event_id) AS status,
     arg_max(CASE WHEN event_type = 'error' THEN 'http_error' END, event_id) FILTER (event_type = 'error') AS err,
     max(event_id) FILTER (event_type = 'error') AS err_id, max(event_id) AS any_id,
     arg_max(content_hash, event_id) FILTER (event_type = 'view') AS content_hash, max(t) FILTER (event_type = 'view') AS last_changed
   FROM log WHERE NOT is_old GROUP BY url)
SELECT COALESCE(o.url, f.url) AS url, COALESCE(f.status, o.status) AS status, COALESCE(f.content_hash, o.content_hash) AS content_hash,
  COALESCE(o.first_seen, f.first_seen) AS first_seen, COALESCE(f.last_crawled, o.last_crawled) AS last_crawled, f.last_changed AS last_changed,
  CASE WHEN f.err_id = f.any_id THEN f.err END AS error
FROM old o FULL JOIN fresh f ON o.url = f.url"""
)
def state_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://users.example.com/"), "user_id").alias("url"),
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_crawled"),
        (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("is_old"),
        "event_type", F.floor("value").cast("int").alias("status"), F.md5("props").alias("content_hash"),
    )
    newest = F.max(F.struct("seq", "status", "content_hash"))
    old = log.filter("is_old").groupBy("url").agg(
        newest.alias("n"), F.min("last_crawled").alias("first_seen"), F.max("last_crawled").alias("last_crawled")
    )
    empty = {c: F.lit(None).cast("string").alias(c) for c in S.STATE_COLUMNS}
    empty |= {"url": F.col("url"), "status": F.col("n.status").alias("status"), "first_seen": F.col("first_seen"),
              "content_hash": F.col("n.content_hash").alias("content_hash"), "last_crawled": F.col("last_crawled")}
    state = old.select(*[empty[c] for c in S.STATE_COLUMNS])
    view = F.col("event_type") == "view"
    always = F.array(F.lit("status"), F.lit("last_crawled"), F.lit("error"))
    names = F.when(view, F.concat(always, F.array(F.lit("content_hash"), F.lit("last_changed")))).otherwise(always)
    updates = log.filter("NOT is_old").select(
        "url", "seq", "status", "content_hash", "last_crawled", F.col("last_crawled").alias("last_changed"),
        F.when(F.col("event_type") == "error", "http_error").alias("error"), names.alias("set_columns"),
        *[F.lit(None).cast("string").alias(c) for c in ("canonical_url", "etag", "last_modified", "title")],
    )
    return S.upsert_state(state, updates).select(
        "url", "status", "content_hash", "first_seen", "last_crawled", "last_changed", "error"
    )


SQL_DECISION = """CASE WHEN status = 301 THEN 'redirect_not_followed' WHEN status = 304 THEN 'unchanged_304'
  WHEN status >= 400 THEN 'http_error' WHEN is_asset THEN 'asset' WHEN content_type LIKE 'Text/HTML%' THEN 'indexed'
  WHEN content_type = 'application/octet-stream' THEN 'duplicate_content' ELSE 'noindex' END"""


def decisions(spark, sf_dir):
    status, kind = F.col("status"), F.col("content_type")
    decision = (
        F.when(status == 301, "redirect_not_followed").when(status == 304, "unchanged_304").when(status >= 400, "http_error")
        .when(F.col("is_asset"), "asset").when(kind.startswith("Text/HTML"), "indexed")
        .when(kind == "application/octet-stream", "duplicate_content").otherwise("noindex")
    )
    return responses(spark, sf_dir).select("event_id", "url", "status", decision.alias("decision"))


@query("WITH " + SQL_RESPONSES + f" SELECT event_id, url, {SQL_DECISION} AS decision FROM responses")
def crawl_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).select("event_id", "url", "decision")


@query(
    "WITH " + SQL_RESPONSES + f""", d AS (SELECT {SQL_DECISION} AS decision FROM responses)
SELECT CAST(0 AS BIGINT) AS queued, COUNT(*) AS fetched, COUNT(*) FILTER (decision = 'indexed') AS indexed,
  COUNT(*) FILTER (decision = 'unchanged_304') AS unchanged, COUNT(*) FILTER (decision = 'duplicate_content') AS duplicates,
  CAST(0 AS BIGINT) AS skipped_robots, COUNT(*) FILTER (decision = 'noindex') AS skipped_noindex, CAST(0 AS BIGINT) AS skipped_scope,
  COUNT(*) FILTER (decision = 'redirect_not_followed') AS skipped_redirect, CAST(0 AS BIGINT) AS skipped_media,
  CAST(0 AS BIGINT) AS rendered, COUNT(*) FILTER (decision = 'asset') AS assets, COUNT(*) FILTER (decision = 'http_error') AS errors FROM d"""
)
def crawl_stats(spark, sf_dir):
    return S.crawl_stats(decisions(spark, sf_dir))


@query(
    "WITH " + SQL_RESPONSES
    + """ SELECT COALESCE(CASE WHEN status = 301 THEN 'redirect_not_followed' WHEN status >= 400 THEN 'http_' || status END, 'ok') AS outcome,
  COUNT(*) AS n FROM responses GROUP BY 1"""
)
def crawl_outcomes(spark, sf_dir):
    error = F.when(F.col("status") == 301, "redirect_not_followed").when(
        F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string"))
    )
    return S.crawl_outcomes(responses(spark, sf_dir).select("url", error.alias("error")))


@query(
    """SELECT user_id AS url, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS crawled_at, arg_max(event_id, event_id) AS version,
  arg_max(event_type, event_id) AS title FROM events GROUP BY user_id"""
)
def documents_latest(spark, sf_dir):
    versions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("url"), F.col("ts").alias("crawled_at"), F.col("event_id").alias("version"),
        F.col("event_type").alias("title"),
    )
    latest = S.latest_per_url(versions)
    return latest.withColumn("crawled_at", F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss"))
