"""Scans and URL functions over the ``pages`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import html as H
from ..functions import urls as U
from ..operators import frontier
from .catalog import query, table

CONFIG = CrawlConfig(
    seeds=["https://www.example.com/"],
    allowed_domains=["example.com", "example.org"],
    include_patterns=["/(en|fr)/", "/[a-z]+$"],
    exclude_patterns=["[?&]page=", "spam-farm"],
    max_depth=1,
)

SQL_TRACKING = (
    "(?i)^(utm_[a-z_]+|gclid|gclsrc|dclid|fbclid|msclkid|mc_[a-z]+|_hs[a-z]*|igshid|ref|ref_src|source|gtm_latency)$"
)
SQL_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def sql_canonical(source: str, result: str) -> str:
    """CTEs that add ``canon`` to relation ``source``, whose column ``u`` is an absolute URL or NULL."""
    decoded = "url_decode(replace({0}, '+', ' '))"
    return f"""
{result}_a AS (
  SELECT *,
    lower(regexp_extract(trim(u), '^({SQL_SCHEME}):', 1)) AS sch,
    regexp_replace(regexp_extract(trim(u), '^{SQL_SCHEME}://([^/?#]*)', 1), '^.*@', '') AS auth,
    regexp_replace(regexp_extract(trim(u), '^{SQL_SCHEME}://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g') AS pth,
    regexp_extract(trim(u), '^[^?#]*\\?([^#]*)', 1) AS qry
  FROM {source}),
{result}_b AS (
  SELECT *, lower(regexp_replace(auth, ':[0-9]*$', '')) AS hst, regexp_extract(auth, ':([0-9]+)$', 1) AS prt,
    array_to_string(list_transform(list_filter(list_sort(list_transform(
      list_filter(string_split(qry, '&'), lambda x: x <> ''),
      lambda x: {{'k': {decoded.format("split_part(x, '=', 1)")}, 'v': {decoded.format("regexp_extract(x, '^[^=]*=(.*)$', 1)")}}})),
      lambda p: NOT regexp_matches(p.k, '{SQL_TRACKING}')), lambda p: p.k || '=' || p.v), '&') AS qs
  FROM {result}_a),
{result} AS (
  SELECT * EXCLUDE (sch, auth, pth, qry, hst, prt, qs),
    CASE WHEN sch IN ('http', 'https') AND hst <> '' THEN
      sch || '://' || hst
      || CASE WHEN prt = '' OR (sch = 'http' AND prt = '80') OR (sch = 'https' AND prt = '443') THEN '' ELSE ':' || prt END
      || CASE WHEN pth = '' THEN '/' ELSE regexp_replace(pth, '/index\\.(html|htm|php)$', '/') END
      || CASE WHEN qs = '' THEN '' ELSE '?' || qs END
    END AS canon
  FROM {result}_b)"""


def sql_host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^{SQL_SCHEME}://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


SQL_LINKS = """
links AS (
  SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))) AS href FROM pages)"""


def page_links(spark, sf_dir) -> DataFrame:
    """Distinct links of every page as written: ``page_id, url, href``."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.html_hrefs("html")).alias("href"))


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 100""")
def scan_filter_project(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter((F.col("lang") == "en") & (F.col("n_chars") > 100)).select("doc_id", "lang", "n_chars")


@query("""SELECT source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source""")
def scan_pruned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """WITH v AS (
  SELECT page_id, unnest([
    {'kind': 'as_is', 'u': url},
    {'kind': 'upper_host', 'u': '  ' || replace(url, '.example.', '.EXAMPLE.') || ' '},
    {'kind': 'user_info', 'u': replace(url, '://', '://user:pw@')},
    {'kind': 'port', 'u': regexp_replace(regexp_replace(url, '^https://([^/]+)', 'https://\\1:443'), '^http://([^/]+)', 'http://\\1:8080')},
    {'kind': 'query', 'u': regexp_extract(url, '^([^?#]*)', 1) || '?b=2&a=%41+x&UTM_Campaign=z&empty=&&ref=q&b=1'},
    {'kind': 'slashes', 'u': regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '//a///index.html#top'},
    {'kind': 'mail', 'u': 'mailto:info@example.com'}
  ], recursive := true) FROM pages), """
    + sql_canonical("v", "c")
    + " SELECT page_id, kind, canon AS url FROM c"
)
def url_normalize(spark, sf_dir):
    url = F.col("url")
    variants = {
        "as_is": url,
        "upper_host": F.concat(F.lit("  "), F.replace(url, F.lit(".example."), F.lit(".EXAMPLE.")), F.lit(" ")),
        "user_info": F.replace(url, F.lit("://"), F.lit("://user:pw@")),
        "port": F.regexp_replace(F.regexp_replace(url, "^https://([^/]+)", "https://$1:443"), "^http://([^/]+)", "http://$1:8080"),
        "query": F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?b=2&a=%41+x&UTM_Campaign=z&empty=&&ref=q&b=1")),
        "slashes": F.concat(F.regexp_extract(url, r"^([a-z]+://[^/]*)", 1), F.lit("//a///index.html#top")),
        "mail": F.lit("mailto:info@example.com"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("raw")) for k, v in variants.items()])
    return (
        table(spark, sf_dir, "pages").select("page_id", F.inline(rows)).select("page_id", "kind", U.canonical_url("raw").alias("url"))
    )


@query(
    "WITH "
    + SQL_LINKS
    + """, w AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS o, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*/)', 1) AS folder
   FROM links),
 v AS (SELECT page_id, href, unnest([
    {'kind': 'rooted', 'u': o || href},
    {'kind': 'child', 'u': o || folder || substr(href, 2)},
    {'kind': 'parent', 'u': o || regexp_replace(folder, '[^/]+/$', '') || substr(href, 2)},
    {'kind': 'dots', 'u': o || folder || 'b' || href},
    {'kind': 'other_host', 'u': regexp_extract(o, '^([a-z]+:)', 1) || '//cdn.example.net' || href},
    {'kind': 'same_page', 'u': regexp_extract(url, '^([^?#]*)', 1) || '?v=' || substr(href, 2)},
    {'kind': 'fragment', 'u': NULL}
  ], recursive := true) FROM w), """
    + sql_canonical("v", "c")
    + " SELECT page_id, href, kind, canon AS target FROM c"
)
def url_resolve(spark, sf_dir):
    href = F.col("href")
    word = F.expr("substr(href, 2)")
    forms = {
        "rooted": href,
        "child": word,
        "parent": F.concat(F.lit("../"), word),
        "dots": F.concat(F.lit("./a/../b"), href),
        "other_host": F.concat(F.lit("//cdn.example.net"), href),
        "same_page": F.concat(F.lit("?v="), word),
        "fragment": F.concat(F.lit("#"), word),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("ref")) for k, v in forms.items()])
    return page_links(spark, sf_dir).select("page_id", "url", "href", F.inline(rows)).select(
        "page_id", "href", "kind", U.canonical_url("ref", "url").alias("target")
    )


@query(
    f"""WITH p AS (SELECT unnest(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS kv FROM pages)
SELECT split_part(kv, '=', 1) AS param, regexp_matches(split_part(kv, '=', 1), '{SQL_TRACKING}') AS is_tracking, COUNT(*) AS n
FROM p GROUP BY ALL"""
)
def url_tracking_params(spark, sf_dir):
    pairs = table(spark, sf_dir, "pages").select(F.explode(U.query_pairs(U.url_query("url"))).alias("p"))
    return pairs.groupBy(F.col("p.k").alias("param"), U.is_tracking_param("p.k").alias("is_tracking")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"SELECT page_id, {sql_host('url')} AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_host("url").alias("host"))


@query(
    f"""SELECT page_id, ({sql_host('url')} = 'example.com' OR {sql_host('url')} LIKE '%.example.com'
  OR {sql_host('url')} = 'example.org' OR {sql_host('url')} LIKE '%.example.org') AS allowed FROM pages"""
)
def url_in_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.in_domains("url", CONFIG.allowed_domains).alias("allowed"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.[^./]*$')
  THEN regexp_extract(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\\.[^./]*)$', 1) ELSE '' END AS ext FROM pages"""
)
def url_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_extension("url").alias("ext"))


@query(
    """SELECT page_id, url FROM pages
WHERE (regexp_matches(url, '(?i)/(en|fr)/') OR regexp_matches(url, '(?i)/[a-z]+$'))
  AND NOT regexp_matches(url, '(?i)[?&]page=') AND NOT regexp_matches(url, '(?i)spam-farm')"""
)
def url_scope_filter(spark, sf_dir):
    keep = U.matches_scope("url", CONFIG.include_patterns, CONFIG.exclude_patterns)
    return table(spark, sf_dir, "pages").filter(keep).select("page_id", "url")


@query(
    """WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages)
SELECT page_id, COALESCE(seg[1], '(home)') AS section FROM p"""
)
def url_section(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_section("url").alias("section"))


@query("""SELECT page_id, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') AS doc_url FROM pages""")
def eval_url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.eval_url("url").alias("doc_url"))


_SUFFIXES = ["", ".PNG", ".pdf", ".woff2", ".csv?download=1", ".html"]
SQL_FILES = f"""
files AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href || s AS target
  FROM links, unnest({_SUFFIXES}) AS t(s))"""
SQL_MEDIA = ", ".join(f"'{e}'" for e in U.MEDIA_EXTENSIONS)


def file_links(spark, sf_dir) -> DataFrame:
    """Every page link in six spellings, so that all kinds of files occur."""
    suffixes = F.array(*[F.lit(s) for s in _SUFFIXES])
    return page_links(spark, sf_dir).select("page_id", "url", "href", F.explode(suffixes).alias("s")).select(
        "page_id", F.concat(U.url_origin("url"), "href", "s").alias("target")
    )


@query(
    "WITH " + SQL_LINKS + "," + SQL_FILES
    + f"""SELECT page_id, target, regexp_extract(lower(regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(\\.[^./]*)$', 1)
  IN ({SQL_MEDIA}) AS is_media FROM files"""
)
def media_filter(spark, sf_dir):
    return file_links(spark, sf_dir).withColumn("is_media", U.is_media("target"))


@query(
    "WITH " + SQL_LINKS + "," + SQL_FILES
    + """SELECT page_id, COUNT(*) FILTER (WHERE regexp_matches(lower(split_part(target, '?', 1)), '\\.(pdf|docx|doc|pptx|ppt|txt|csv)$')) AS assets,
  COUNT(*) FILTER (WHERE NOT regexp_matches(lower(split_part(target, '?', 1)), '\\.(pdf|docx|doc|pptx|ppt|txt|csv)$')) AS links
FROM files GROUP BY page_id"""
)
def link_asset_split(spark, sf_dir):
    asset = U.is_asset_link("target")
    return file_links(spark, sf_dir).groupBy("page_id").agg(
        F.count_if(asset).alias("assets"), F.count_if(~asset).alias("links")
    )


SQL_RESPONSES = """
responses AS (
  SELECT event_id, user_id, 'https://files.example.com/u' || user_id || '/f' || event_id
      || CASE event_type WHEN 'error' THEN '.bin' WHEN 'click' THEN '.CSV' WHEN 'purchase' THEN '.dat' ELSE '' END AS url,
    CASE event_type WHEN 'view' THEN 'Text/HTML; charset=utf-8' WHEN 'purchase' THEN 'application/pdf'
      WHEN 'signup' THEN 'image/png' WHEN 'click' THEN 'application/octet-stream' ELSE '' END AS content_type,
    CASE WHEN event_type = 'error' AND value >= 20 THEN 404 WHEN event_type = 'error' THEN 503
      WHEN event_type = 'signup' AND value < 3 THEN 301 WHEN event_type = 'view' AND value < 1 THEN 304 ELSE 200 END AS status,
    event_type = 'purchase' AND value > 10 AS is_asset
  FROM events)"""


def responses(spark, sf_dir) -> DataFrame:
    """The event table read as a log of HTTP responses."""
    kind, value = F.col("event_type"), F.col("value")
    suffix = F.when(kind == "error", ".bin").when(kind == "click", ".CSV").when(kind == "purchase", ".dat").otherwise("")
    content_type = (
        F.when(kind == "view", "Text/HTML; charset=utf-8").when(kind == "purchase", "application/pdf")
        .when(kind == "signup", "image/png").when(kind == "click", "application/octet-stream").otherwise("")
    )
    status = (
        F.when((kind == "error") & (value >= 20), 404).when(kind == "error", 503)
        .when((kind == "signup") & (value < 3), 301).when((kind == "view") & (value < 1), 304).otherwise(200)
    )
    url = F.concat(F.lit("https://files.example.com/u"), F.col("user_id"), F.lit("/f"), F.col("event_id"), suffix)
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", url.alias("url"), content_type.alias("content_type"), status.alias("status"),
        ((kind == "purchase") & (value > 10)).alias("is_asset"),
    )


SQL_MEDIA_TYPE = "lower(trim(split_part(content_type, ';', 1)))"
SQL_IS_DOCUMENT = f"""(regexp_matches({SQL_MEDIA_TYPE},
  '^(application/pdf|application/msword|application/vnd\\.openxmlformats-officedocument|application/vnd\\.ms-|application/rtf|text/)')
  OR regexp_matches(lower(url), '\\.(pdf|docx|doc|pptx|ppt|txt|csv)$'))"""


@query(
    "WITH " + SQL_RESPONSES
    + f"SELECT event_id, {SQL_MEDIA_TYPE} AS media_type, {SQL_IS_DOCUMENT} AS keep FROM responses"
)
def asset_type_filter(spark, sf_dir):
    from ..functions.http import media_type

    rows = responses(spark, sf_dir).withColumn("media_type", media_type("content_type"))
    return rows.select("event_id", "media_type", U.is_document_type("media_type", "url").alias("keep"))


@query(
    "WITH " + SQL_RESPONSES
    + f"SELECT event_id, {SQL_MEDIA_TYPE} IN ('text/html', 'application/xhtml+xml', '') AS is_html FROM responses"
)
def html_type_filter(spark, sf_dir):
    from ..functions.http import media_type

    return responses(spark, sf_dir).select("event_id", U.is_html_type(media_type("content_type")).alias("is_html"))


@query(
    "WITH v AS (SELECT page_id, url AS u FROM pages), " + sql_canonical("v", "c")
    + f"""SELECT page_id, canon AS url, (regexp_matches({sql_host('canon')}, '(^|\\.)example\\.(com|org)$')
  AND (regexp_matches(canon, '(?i)/(en|fr)/') OR regexp_matches(canon, '(?i)/[a-z]+$'))
  AND NOT regexp_matches(canon, '(?i)[?&]page=') AND NOT regexp_matches(canon, '(?i)spam-farm')) AS in_scope FROM c"""
)
def url_in_scope(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", U.canonical_url("url").alias("url"))
    return pages.withColumn("in_scope", frontier.in_scope("url", CONFIG))


@query(
    "WITH " + SQL_RESPONSES
    + """SELECT event_id, substr(sha1(url), 1, 16) || CASE WHEN regexp_matches(url, '\\.[A-Za-z]+$')
  THEN regexp_extract(url, '(\\.[A-Za-z]+)$', 1) ELSE '.bin' END AS file_name FROM responses"""
)
def asset_name(spark, sf_dir):
    return responses(spark, sf_dir).select("event_id", U.asset_file_name("url").alias("file_name"))
