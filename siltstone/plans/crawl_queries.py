"""Frontier, routing, robots, sitemaps and request slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import html as H
from ..functions import http as X
from ..functions import urls as U
from ..operators import frontier as FR
from ..operators import sitemaps as SM
from ..session import materialise, shared_path
from .catalog import query, table
from .page_queries import SQL_MAIN
from .url_queries import SQL_IS_DOCUMENT, SQL_LINKS, SQL_MEDIA, SQL_MEDIA_TYPE, SQL_RESPONSES, page_links, responses, sql_canonical, sql_host

CONFIG = CrawlConfig(
    seeds=["https://www.example.com/"], allowed_domains=["example.com", "example.org"], exclude_patterns=["/the$", "spam-farm"], max_depth=1,
)
AGENT = "siltstone/1.0"

SQL_CANDIDATES = (
    SQL_LINKS
    + """, cand AS (SELECT page_id AS seq, 0 AS depth, url AS u FROM pages
  UNION ALL SELECT page_id, 1, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href || s FROM links, unnest(['', '.png']) AS t(s)
  UNION ALL SELECT page_id, 2, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/deep' FROM pages
  UNION ALL SELECT page_id, 1, 'mailto:x@example.com' FROM pages),"""
)


def candidates(spark, sf_dir):
    """Pages as seeds, their links and image links at depth 1, and some links that are too deep."""
    pages = table(spark, sf_dir, "pages")
    origin = U.url_origin("url")
    seq = F.col("page_id").alias("seq")
    links = page_links(spark, sf_dir).withColumn("s", F.explode(F.array(F.lit(""), F.lit(".png"))))
    rows = (
        pages.select(seq, F.lit(0).alias("depth"), F.col("url").alias("raw_url"))
        .unionByName(links.select(seq, F.lit(1).alias("depth"), F.concat(origin, "href", "s").alias("raw_url")))
        .unionByName(pages.select(seq, F.lit(2).alias("depth"), F.concat(origin, F.lit("/deep")).alias("raw_url")))
        .unionByName(pages.select(seq, F.lit(1).alias("depth"), F.lit("mailto:x@example.com").alias("raw_url")))
    )
    return rows.withColumns({"lastmod": F.lit(None).cast("string"), "is_asset": F.lit(False)})


SQL_GATED = (
    "WITH " + SQL_CANDIDATES + sql_canonical("cand", "c")
    + f""", gated AS (SELECT seq, depth, canon AS url, CASE WHEN canon IS NULL THEN 'not_crawlable' WHEN depth > 1 THEN 'too_deep'
   WHEN regexp_extract(lower(regexp_extract(canon, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(\\.[^./]*)$', 1) IN ({SQL_MEDIA}) THEN 'skipped_media'
   WHEN NOT regexp_matches({sql_host('canon')}, '(^|\\.)example\\.(com|org)$') THEN 'out_of_domain'
   WHEN regexp_matches(canon, '(?i)/the$') OR regexp_matches(canon, '(?i)spam-farm') THEN 'skipped_scope' ELSE 'candidate' END AS decision FROM c)"""
)


@query(SQL_GATED + " SELECT decision, depth, COUNT(*) AS n FROM gated GROUP BY ALL")
def frontier_gate(spark, sf_dir):
    return FR.gate(candidates(spark, sf_dir), CONFIG).groupBy("decision", "depth").agg(F.count(F.lit(1)).alias("n"))


SQL_FRONTIER = SQL_GATED + """, seen AS (SELECT DISTINCT url FROM gated WHERE decision = 'candidate' AND depth = 0 AND seq IN (SELECT doc_id FROM labels)),
 front AS (SELECT url, MIN(depth) AS depth FROM gated WHERE decision = 'candidate' AND url NOT IN (SELECT url FROM seen) GROUP BY url)"""


def _frontier(spark, sf_dir):
    gated = materialise(FR.gate(candidates(spark, sf_dir), CONFIG), "gated")
    known = gated.filter("decision = 'candidate' AND depth = 0").join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq")), "seq", "left_semi"
    )
    return FR.enqueue(gated, known)


@query(SQL_FRONTIER + " SELECT url, depth FROM front")
def frontier_enqueue(spark, sf_dir):
    return _frontier(spark, sf_dir).select("url", "depth")


@query(SQL_FRONTIER + " SELECT url, depth FROM front ORDER BY depth, substr(md5(url), 1, 3), url LIMIT 150")
def budget_limit(spark, sf_dir):
    return FR.within_budget(_frontier(spark, sf_dir), 150).select("url", "depth")


SQL_EDGES = """
edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


@query(
    "WITH RECURSIVE " + SQL_EDGES + """, walk(node, depth) AS (SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 1000
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT node, MIN(depth) AS depth FROM walk GROUP BY node"""
)
def bfs_depth(spark, sf_dir):
    item, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = (
        item.select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst"))
        .unionByName(item.select(node("p", "l_partkey").alias("src"), node("o", "l_orderkey").alias("dst")))
        .unionByName(orders.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst")))
    )
    seeds = table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select(node("s", "s_suppkey").alias("node"))
    return FR.walk_depths(edges, seeds, 3)


@query(
    "WITH " + SQL_RESPONSES + f""" SELECT event_id, CASE WHEN status = 301 THEN 'redirect_not_followed' WHEN status = 304 THEN 'unchanged_304'
  WHEN status >= 400 THEN 'http_error' WHEN (is_asset OR {SQL_MEDIA_TYPE} NOT IN ('text/html', 'application/xhtml+xml', '')) THEN
    CASE WHEN {SQL_IS_DOCUMENT} THEN 'asset' ELSE 'unsupported_media' END ELSE 'html' END AS decision FROM responses"""
)
def status_route(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("content_type", X.media_type("content_type"))
    return rows.select("event_id", FR.route("status", "content_type", "url", "is_asset", CONFIG).alias("decision"))


# A part redirects to the part with half its number while it is large; odd targets are out of scope.
@query(
    """WITH RECURSIVE hops AS (SELECT 'https://www.example.com/p' || p_partkey AS url, p_partkey AS k, CASE WHEN p_size > 10 THEN 301 ELSE 200 END AS status,
    CASE WHEN p_size > 10 THEN p_partkey // 2 END AS nxt, p_size FROM part),
 walk(url, k, hop) AS (SELECT url, k, 0 FROM hops UNION ALL
   SELECT w.url, h.nxt, w.hop + 1 FROM walk w JOIN hops h ON h.k = w.k WHERE h.nxt IS NOT NULL AND h.nxt <> w.k AND h.nxt % 7 <> 3 AND w.hop < 5),
 last AS (SELECT url, arg_max(k, hop) AS k, MAX(hop) AS hops FROM walk GROUP BY url)
SELECT l.url, 'https://www.example.com/p' || l.k AS final_url, h.status, CAST(l.hops AS INTEGER) AS hops FROM last l LEFT JOIN hops h ON h.k = l.k"""
)
def redirect_resolve(spark, sf_dir):
    at = lambda c: F.concat(F.lit("https://www.example.com/p"), c.cast("string"))
    moved = F.col("p_size") > 10
    half = F.floor(F.col("p_partkey") / 2)
    hops = table(spark, sf_dir, "part").select(
        at(F.col("p_partkey")).alias("url"), F.when(moved, 301).otherwise(200).alias("status"),
        F.when(moved, F.concat(F.lit("/p"), half.cast("string"))).alias("location"),
    )
    allowed = F.regexp_extract("target", r"(\d+)$", 1).cast("bigint") % 7 != 3
    return FR.follow_redirects(hops.select("url"), hops, allowed)


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN least(floor(value), 60) WHEN 'view' THEN least(pow(2, user_id % 8), 60)
  ELSE least(pow(2, user_id % 8), 60) END::DOUBLE AS wait FROM events"""
)
def backoff_schedule(spark, sf_dir):
    kind = F.col("event_type")
    after = F.when(kind == "click", F.floor("value").cast("string")).when(kind == "view", "Fri, 31 Dec 1999 23:59:59 GMT")
    return table(spark, sf_dir, "events").select(
        "event_id", X.backoff_seconds(F.col("user_id") % 8, after).alias("wait")
    )


@query(
    f"""WITH p AS (SELECT page_id, url, {sql_host('url')} AS host, CAST(length(url) % 3 AS INTEGER) AS depth FROM pages)
SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY depth, substr(md5(url), 1, 3), url) AS slot,
  CASE WHEN host LIKE 'www.%' THEN 2.5 ELSE 1.0 END * (slot - 1)::DOUBLE AS start_at FROM p"""
)
def politeness_slots(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", (F.length("url") % 3).alias("depth"))
    hosts = pages.select(U.url_host("url").alias("host")).distinct()
    delays = hosts.withColumn("crawl_delay", F.when(F.col("host").startswith("www."), 2.5).otherwise(0.5))
    return FR.request_slots(pages, delays, 1.0).select("url", "host", "slot", "start_at")


@query(
    f"""WITH p AS (SELECT page_id, url, {sql_host('url')} AS host, CAST(length(url) % 3 AS INTEGER) AS depth FROM pages)
SELECT url, host, CASE WHEN host LIKE 'www.%' THEN 2.5 ELSE 1.0 END
  * (row_number() OVER (PARTITION BY host ORDER BY depth, substr(md5(url), 1, 3), url) - 1)::DOUBLE AS start_at FROM p"""
)
def stream_politeness(spark, sf_dir):
    """The same start times from a stream: each depth arrives by itself, and the stream goes on from its checkpoint."""
    from ..streaming import scheduler as SC

    pages = table(spark, sf_dir, "pages").select("url", (F.length("url") % 3).alias("depth"), F.lit(0.0).alias("asked_at"))
    hosts = pages.select(U.url_host("url").alias("host")).distinct()
    delays = materialise(hosts.withColumn("crawl_delay", F.when(F.col("host").startswith("www."), 2.5).otherwise(0.5)), "delays")
    path = shared_path(spark, "schedule")
    for depth in range(3):
        pages.filter(F.col("depth") == depth).write.mode("append").parquet(f"{path}/feed")
        stream = spark.readStream.schema(pages.schema).parquet(f"{path}/feed")
        SC.schedule_stream(stream, delays, path, f"{path}/checkpoint", 1.0).awaitTermination()
    return SC.scheduled(spark, path).select("url", "host", "start_at")


def robots_files(spark, sf_dir):
    """One robots.txt per host, derived from the host's name."""
    host = F.col("host")
    text = F.concat(
        F.lit("# rules\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/\nDisallow: /fr/\n"),
        F.when(host.startswith("blog."), "Crawl-delay: 4\n").otherwise(""),
        F.lit("Sitemap: https://"), host, F.lit("/sitemap.xml\nsitemap:  https://"), host, F.lit("/news.xml # news\n"),
    )
    status = F.when(host.endswith(".net"), 404).when(host.startswith("www."), 403).otherwise(200)
    hosts = table(spark, sf_dir, "pages").select(U.url_host("url").alias("host")).distinct()
    return hosts.select("host", text.alias("robots_txt"), status.alias("status"))


@query(
    f"""WITH p AS (SELECT page_id, url, {sql_host('url')} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN host LIKE '%.net' THEN TRUE WHEN host LIKE 'www.%' THEN FALSE
  ELSE starts_with(path, '/en/1') OR NOT (starts_with(path, '/en/') OR starts_with(path, '/fr/')) END AS allowed,
  CASE WHEN host LIKE 'blog.%' AND NOT host LIKE '%.net' THEN 4.0 END::DOUBLE AS crawl_delay FROM p"""
)
def robots_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", U.url_host("url"))
    joined = pages.select("page_id", "url", "host").join(robots_files(spark, sf_dir), "host", "left")
    return joined.select(
        "page_id", X.robots_allows(AGENT)("robots_txt", "status", "url").alias("allowed"),
        X.robots_crawl_delay(AGENT)("robots_txt", "status").alias("crawl_delay"),
    )


@query(
    f"""WITH h AS (SELECT DISTINCT {sql_host('url')} AS host FROM pages)
SELECT host, 'https://' || host || f AS sitemap FROM h, unnest(['/sitemap.xml', '/news.xml']) AS t(f)"""
)
def robots_sitemaps(spark, sf_dir):
    return robots_files(spark, sf_dir).select("host", F.explode(X.robots_sitemaps("robots_txt")).alias("sitemap"))


def sitemap_files(spark, sf_dir):
    """Per page one index naming two url sets, its own and the next page's; some files are broken."""
    pid = F.col("page_id")
    name = lambda kind, n: F.concat(F.lit(f"https://maps.example.com/{kind}"), n.cast("string"), F.lit(".xml"))
    ns = '<?xml version="1.0"?><{} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    entry = lambda tag, loc, mod="": F.concat(F.lit(f"<{tag}><loc> "), loc, F.lit(" </loc>"), F.lit(mod) if isinstance(mod, str) else mod, F.lit(f"</{tag}>"))
    mod = F.concat(F.lit("<lastmod>2024-01-"), F.lpad((pid % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))
    pages = table(spark, sf_dir, "pages").select("page_id", U.canonical_url("url").alias("u"), H.html_hrefs("html").alias("hrefs"))
    escaped = lambda h: F.replace(F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(
        F.lit(ns.format("urlset")), F.array_join(F.transform("hrefs", lambda h: entry("url", escaped(h))), ""),
        entry("url", F.concat(F.lit("https://pages.example.com/"), pid.cast("string")), mod), F.when(pid % 10 == 7, "").otherwise("</urlset>"),
    )
    index = F.concat(F.lit(ns.format("sitemapindex")), entry("sitemap", name("set", pid)), entry("sitemap", name("set", pid + 1)), F.lit("</sitemapindex>"))
    leaf = pages.select(name("set", pid).alias("url"), body.cast("binary").alias("content"))
    return pages.select(name("index", pid).alias("url"), index.cast("binary").alias("content")), leaf


@query(
    "WITH " + SQL_LINKS + """, l AS (SELECT CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '//%' THEN 'https:' || href
   WHEN href LIKE '/%' THEN 'https://maps.example.com' || href ELSE 'https://maps.example.com/' || href END AS u FROM links WHERE page_id % 10 <> 7), """
    + sql_canonical("l", "c")
    + """ SELECT DISTINCT canon AS url, CAST(NULL AS VARCHAR) AS lastmod FROM c WHERE canon IS NOT NULL
UNION ALL SELECT 'https://pages.example.com/' || page_id, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') FROM pages WHERE page_id % 10 <> 7"""
)
def sitemap_discover(spark, sf_dir):
    index, leaf = sitemap_files(spark, sf_dir)
    return SM.discover(index.unionByName(leaf), index.select("url"))


@query(
    "WITH " + SQL_MAIN + ", v AS (SELECT page_id, url AS u, text FROM main), " + sql_canonical("v", "c")
    + f""", f AS (SELECT canon AS url, arg_min(text, page_id) AS text FROM c
   WHERE regexp_matches({sql_host('canon')}, '(^|\\.)example\\.(com|org)$') AND NOT regexp_matches(canon, '(?i)/the$')
     AND NOT regexp_matches(canon, '(?i)spam-farm') GROUP BY canon)
SELECT url, sha256(text) AS content_hash, text <> '' AND row_number() OVER (PARTITION BY sha256(text) ORDER BY url) > 1 AS is_duplicate FROM f"""
)
def crawl_pages(spark, sf_dir):
    """A crawl level over the page table: decisions of every page from gate to duplicate check."""
    from ..operators.state import content_hash, mark_duplicates

    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("seq"), F.lit(0).alias("depth"), F.col("url").alias("raw_url"),
                        F.lit(None).cast("string").alias("lastmod"), F.lit(False).alias("is_asset"))
    gated = FR.gate(rows, CONFIG)
    front = materialise(FR.enqueue(gated, None).select("url"), "frontier")
    stored = pages.withColumn("url", U.canonical_url("url")).groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    hit = front.join(stored, "url").withColumn("p", H.parsed_page("html"))
    text = H.page_columns(F.col("p"), F.col("url"))["text"]
    return mark_duplicates(hit.select("url", content_hash(text).alias("content_hash")), ["url"])
