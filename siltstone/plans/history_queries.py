"""Version history, grouped reports, mergeable sketches and JSON of unknown shape over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import variants as VA
from ..operators import history as HI
from ..operators import rollups as R
from ..operators import sketches as SK
from ..operators.profile import modified_year
from ..session import materialise, shared_path
from .catalog import query, table
from .report_queries import SQL_TERMS, SQL_URL_SECTION, SQL_WORDS
from .url_queries import sql_host

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def observed(spark, sf_dir):
    """Views are crawls of a user's page: its content hash at a time."""
    views = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return views.select("user_id", "ts", F.col("event_id").alias("version_id"), (F.floor("value") % 3).alias("content"))


@query(
    """SELECT e.event_id, e.user_id, v.event_id AS version_id, CAST(floor(v.value) AS BIGINT) % 3 AS content
FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def asof_versions(spark, sf_dir):
    """For every event, the version of its user's page that was live then."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return HI.as_of_join(events, observed(spark, sf_dir), ["user_id"], "ts", ["version_id", "content"], tie="version_id").drop("ts")


@query(
    f"""WITH v AS (SELECT user_id, ts, event_id, CAST(floor(value) AS BIGINT) % 3 AS content FROM events WHERE event_type = 'view'),
 c AS (SELECT * FROM v QUALIFY lag({{'c': content}}) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM {{'c': content}})
SELECT user_id, content, strftime(ts, '{SQL_STAMP}') AS valid_from,
  strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '{SQL_STAMP}') AS valid_to FROM c"""
)
def version_intervals(spark, sf_dir):
    found = HI.version_intervals(observed(spark, sf_dir), ["user_id"], "ts", "content", "version_id")
    return found.select("user_id", "content", *[F.date_format(c, STAMP).alias(c) for c in ("valid_from", "valid_to")])


SQL_SITE = f"""site AS (SELECT {sql_host('url')} AS host, {SQL_URL_SECTION} AS section,
  CASE WHEN page_id % 9 = 0 THEN '(unknown)' ELSE CAST(2020 + page_id % 4 AS VARCHAR) END AS year FROM pages)"""
SQL_LEVELS = """lv AS (SELECT host, section, year, CAST(GROUPING(host, section, year) AS INTEGER) AS level, CAST(SUM(1) AS BIGINT) AS n,
  COUNT(DISTINCT h) AS distinct_host, COUNT(DISTINCT s) AS distinct_section, COUNT(DISTINCT y) AS distinct_year
  FROM (SELECT *, host AS h, section AS s, year AS y FROM site) GROUP BY {0}),
 sh AS (SELECT *, round(n * 100.0::DOUBLE / (SELECT COUNT(*) FROM site), 6) AS pct FROM lv)"""


def site(spark, sf_dir):
    """Pages by host, section and year of change; some have no readable date."""
    pid = F.col("page_id")
    changed = F.when(pid % 9 == 0, "last week").otherwise(F.concat((2020 + pid % 4).cast("string"), F.lit("-03-01")))
    return table(spark, sf_dir, "pages").select(
        U.url_host("url").alias("host"), U.url_section("url").alias("section"), modified_year(changed, F.lit("")).alias("year")
    )


@query("WITH " + SQL_SITE + "," + SQL_LEVELS.format("CUBE (host, section, year)") + " SELECT * FROM sh")
def site_cube(spark, sf_dir):
    """Pages, distinct values and shares for every combination of host, section and year."""
    return R.cube_report(site(spark, sf_dir), ["host", "section", "year"])


@query(
    "WITH " + SQL_SITE + "," + SQL_LEVELS.format("ROLLUP (host, section, year)")
    + """ SELECT c.*, round(c.n * 100.0::DOUBLE / p.n, 6) AS pct_parent FROM sh c LEFT JOIN sh p ON p.level = CASE c.level WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 7 END
  AND (p.level = 7 OR p.host IS NOT DISTINCT FROM c.host) AND (p.level <> 1 OR p.section IS NOT DISTINCT FROM c.section)"""
)
def site_rollup(spark, sf_dir):
    """Pages by host, then section, then year, with each level's share of the level above."""
    return R.rollup_report(site(spark, sf_dir), ["host", "section", "year"])


def dated_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("section"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("day"),
        T.report_terms("text").alias("terms"), T.word_count("text").alias("words"),
    )


@query(
    f"""WITH d AS (SELECT source AS section, {SQL_TERMS.format('text')} AS terms, {SQL_WORDS.format('text')} AS words FROM documents)
SELECT section, COUNT(*) AS documents, CAST(SUM(words) AS BIGINT) AS words, CAST(MIN(words) AS INTEGER) AS least, CAST(MAX(words) AS INTEGER) AS most,
  CAST(SUM(len(terms)) AS BIGINT) AS occurrences, TRUE AS terms_ok, TRUE AS median_ok, TRUE AS q90_ok, TRUE AS top_ok FROM d GROUP BY section"""
)
def sketch_report(spark, sf_dir):
    """Days arrive in two loads, the report merges their sketches; each estimate is held against exact counts."""
    docs, path = dated_docs(spark, sf_dir), shared_path(spark, "sketches")
    first = F.col("day") < F.lit("2024-01-04").cast("date")
    SK.store_days(docs.filter(first), path)
    SK.store_days(docs.filter(~first), path)
    found = materialise(SK.report(spark, path, ["section"]), "report")
    same = lambda name: F.col("section").eqNullSafe(F.col(name))
    share = lambda test: F.count_if(test) / F.count("words")
    ranks = docs.join(found.select(F.col("section").alias("of"), "q50", "q90"), same("of")).groupBy(F.col("section").alias("ranked")).agg(*[
        ((share(F.col("words") <= F.col(q)) >= r - SK.RANK_ERROR) & (share(F.col("words") < F.col(q)) <= r + SK.RANK_ERROR)).alias(f"{q}_ok")
        for q, r in (("q50", 0.5), ("q90", 0.9))
    ])
    counts = docs.select("section", F.explode("terms").alias("term")).groupBy("section", "term").agg(F.count(F.lit(1)).alias("n"))
    tops = found.select(F.col("section").alias("of"), "occurrences", F.explode("top").alias("t"))
    off = counts.join(tops, same("of") & (F.col("term") == F.col("t.term")), "left")
    exact = off.groupBy(F.col("section").alias("exactly")).agg(
        F.count(F.lit(1)).alias("exact_terms"),
        F.max(F.coalesce(F.abs(F.col("t.n") - F.col("n")) / F.col("occurrences"), F.lit(0.0))).alias("off"),
    )
    joined = found.join(ranks, same("ranked")).join(exact, same("exactly"))
    return joined.select(
        "section", "documents", "words", "least", "most", "occurrences", SK.within(F.col("terms"), F.col("exact_terms"), SK.DISTINCT_ERROR).alias("terms_ok"),
        F.col("q50_ok").alias("median_ok"), "q90_ok", (F.col("off") <= SK.TERM_ERROR).alias("top_ok"),
    )


SQL_BODY = """b AS (SELECT event_id, CASE WHEN event_id % 19 = 7 THEN NULL ELSE '{"props": ' || props || ', "user": ' || user_id ||
  CASE WHEN event_id % 4 = 0 THEN ', "tags": ["' || event_type || '", "x"]' ELSE '' END || CASE WHEN event_id % 13 = 5 THEN '' ELSE '}' END END AS body FROM events),
 j AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM b)"""


def payloads(spark, sf_dir):
    """Events as JSON bodies: some with tags, some cut short, some missing."""
    eid = F.col("event_id")
    tags = F.when(eid % 4 == 0, F.concat(F.lit(', "tags": ["'), "event_type", F.lit('", "x"]'))).otherwise("")
    body = F.concat(F.lit('{"props": '), "props", F.lit(', "user": '), F.col("user_id").cast("string"), tags, F.when(eid % 13 == 5, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", F.when(eid % 19 != 7, body).alias("body"))


@query(
    "WITH " + SQL_BODY + """ SELECT event_id, CAST(v->>'$.props.k' AS BIGINT) AS k, CAST(v->>'$.user' AS BIGINT) AS user_id, v->>'$.tags[0]' AS tag,
  COALESCE(body IS NOT NULL AND v IS NULL, FALSE) AS malformed FROM j"""
)
def variant_columns(spark, sf_dir):
    """JSON bodies as typed columns, by the schema that an aggregate finds in them."""
    rows = VA.shredded(payloads(spark, sf_dir), "body")
    return rows.select("event_id", F.col("value.props.k").alias("k"), F.col("value.user").alias("user_id"), F.get("value.tags", 0).alias("tag"), "malformed")


@query(
    "WITH " + SQL_BODY + """, f AS (SELECT '$' AS path, CASE WHEN v IS NULL THEN 'MALFORMED' ELSE json_type(v) END AS type FROM j WHERE body IS NOT NULL
 UNION ALL SELECT '$.' || k, json_type(v, '$.' || k) FROM (SELECT v, unnest(json_keys(v)) AS k FROM j WHERE v IS NOT NULL)
 UNION ALL SELECT '$.props.' || k, json_type(v, '$.props.' || k) FROM (SELECT v, unnest(json_keys(v, '$.props')) AS k FROM j WHERE v IS NOT NULL))
SELECT path, CASE type WHEN 'UBIGINT' THEN 'BIGINT' ELSE type END AS type, COUNT(*) AS n FROM f GROUP BY ALL"""
)
def variant_fields(spark, sf_dir):
    """Which fields the bodies have, and of which types."""
    return VA.field_types(payloads(spark, sf_dir), "body")
