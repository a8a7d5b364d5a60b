"""HTML extraction over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import html as H
from ..functions import http as X
from ..functions import text as T
from ..operators import documents as D
from ..operators import frontier
from ..operators import state as S

from .catalog import query, table
from .url_queries import SQL_LINKS, sql_canonical

CONFIG = CrawlConfig(seeds=["https://www.example.com/"], allowed_domains=["example.com"], render_hosts=["example.org"])


def sql_unescape(text: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


# Main content in SQL for pages built from nav, article and footer without nesting: the article when
# it has 200 characters, else the body without nav and footer. Tags become line breaks.
def sql_pieces(html: str) -> str:
    pieces = f"string_split(regexp_replace(regexp_replace({html}, '<!--.*?-->', '', 'gs'), '<[^>]+>', chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda x: trim({sql_unescape('x')}, chr(10) || ' ')), lambda x: x <> '')"


SQL_MAIN = f"""
m0 AS (SELECT page_id, url, html, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art,
    regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<nav>.*?</nav>', '', 's'), '<footer>.*?</footer>', '', 's') AS body FROM pages),
m1 AS (SELECT *, {sql_pieces('art')} AS ap FROM m0),
m2 AS (SELECT page_id, url, html, CASE WHEN len(array_to_string(ap, ' ')) >= 200 THEN art ELSE body END AS main FROM m1),
main AS (SELECT page_id, url, html, main, trim(regexp_replace(regexp_replace(array_to_string({sql_pieces('main')}, chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM m2)"""


def parsed(spark, sf_dir):
    """Pages with their extracted fields."""
    pages = table(spark, sf_dir, "pages").withColumn("parsed", H.parsed_page("html"))
    fields = H.page_columns(F.col("parsed"), F.col("url"))
    return pages.select("page_id", F.col("url"), *[c.alias(n) for n, c in fields.items()])


@query(f"SELECT page_id, trim({sql_unescape(chr(114) + 'egexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')}) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_title("html").alias("title"))


SQL_WITH_META = """
pm AS (SELECT page_id, replace(html, '</head>', '<meta name="description" content="About ' || page_id || ' &amp; more"><meta property="og:title" content=''OG '
  || page_id || '''><META NAME="keywords" CONTENT="a, b ,,' || page_id || '"><meta name="robots" content="'
  || CASE WHEN url LIKE '%#top' THEN 'NoIndex, follow' WHEN url LIKE '%ref=x' THEN 'index,nofollow' ELSE 'all' END
  || '"><meta property="article:published_time" content="2024-01-0' || (page_id % 9 + 1) || '"></head>') AS html, url FROM pages)"""


def pages_with_meta(spark, sf_dir):
    """Pages whose head also carries description, keywords, robots and date tags."""
    pid = F.col("page_id").cast("string")
    robots = F.when(F.col("url").endswith("#top"), "NoIndex, follow").when(F.col("url").endswith("ref=x"), "index,nofollow").otherwise("all")
    tags = F.concat(
        F.lit('<meta name="description" content="About '), pid, F.lit(" &amp; more\"><meta property=\"og:title\" content='OG "), pid,
        F.lit("'><META NAME=\"keywords\" CONTENT=\"a, b ,,"), pid, F.lit('"><meta name="robots" content="'), robots,
        F.lit('"><meta property="article:published_time" content="2024-01-0'), (F.col("page_id") % 9 + 1).cast("string"),
        F.lit('"></head>'),
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("</head>"), tags))


@query(
    "WITH " + SQL_WITH_META + """ SELECT page_id, 'About ' || page_id || ' & more' AS description, 'OG ' || page_id AS og_title,
  'a|b|' || page_id AS keywords, '2024-01-0' || (page_id % 9 + 1) AS published_at FROM pm"""
)
def html_meta(spark, sf_dir):
    words = F.filter(F.transform(F.split(H.html_meta("html", "keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")
    return pages_with_meta(spark, sf_dir).select(
        "page_id", H.html_meta("html", "description").alias("description"),
        H.html_meta("html", "og:title", "property").alias("og_title"), F.array_join(words, "|").alias("keywords"),
        H.html_meta("html", "article:published_time", "property").alias("published_at"),
    )


@query(
    "WITH " + SQL_WITH_META + """ SELECT page_id, url LIKE '%#top' AS noindex, url LIKE '%ref=x' AS nofollow, 'About ' || page_id || ' & more' AS description,
  'a|b|' || page_id AS keywords FROM pm"""
)
def noindex_filter(spark, sf_dir):
    """Directives and meta fields as the tree parser reads them."""
    pages = pages_with_meta(spark, sf_dir).withColumn("parsed", H.parsed_page("html"))
    f = H.page_columns(F.col("parsed"), F.col("url"))
    return pages.select(
        "page_id", f["noindex"].alias("noindex"), f["nofollow"].alias("nofollow"), f["description"].alias("description"),
        F.array_join(f["keywords"], "|").alias("keywords"),
    )


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""")
def html_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_lang("html").alias("language"))


@query("WITH " + SQL_LINKS + " SELECT page_id, href FROM links")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.html_hrefs("html")).alias("href"))


@query(
    "WITH " + SQL_LINKS + ", v AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || href AS u FROM links), "
    + sql_canonical("v", "c") + " SELECT DISTINCT page_id, canon AS target FROM c"
)
def html_link_targets(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.explode("links").alias("target"))


@query("""SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '(?is)<(script|style|nav|footer)\\b[^>]*>.*?</(script|style|nav|footer)\\s*>', '', 'g') AS html FROM pages""")
def html_strip_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.strip_boilerplate_tags("html").alias("html"))


@query("WITH " + SQL_MAIN + " SELECT page_id, text, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count FROM main")
def html_main_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "text", "word_count")


@query(
    "WITH " + SQL_MAIN + f""", blk AS (SELECT page_id, regexp_extract(main, '<h1>(.*?)</h1>', 1) AS h1,
    unnest(list_filter(string_split(regexp_replace(main, '^.*?</h1>', '', 's'), '<p>')[2:], lambda x: x <> '')) AS p FROM main),
 t AS (SELECT page_id, {sql_unescape('trim(h1)')} AS heading, array_to_string({sql_pieces('p')}, ' ') AS p FROM blk)
SELECT page_id, 0 AS pos, heading, 1 AS level, trim(regexp_replace(string_agg(p, chr(10)), '[ \\t]+', ' ', 'g')) AS text FROM t WHERE p <> '' GROUP BY ALL"""
)
def html_sections(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("page_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("page_id", "pos", "s.heading", "s.level", "s.text")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '.', ' ' || chr(9) || ' .' || chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents""")
def text_clean(spark, sf_dir):
    ragged = F.replace("text", F.lit("."), F.lit(" \t .\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(ragged).alias("text"))


@query("""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents""")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


@query(
    "WITH " + SQL_MAIN + """ SELECT page_id, regexp_matches(url, '^[a-z]+://([^/]*\\.)?example\\.org(/|$)')
  OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 60 AS render FROM main"""
)
def needs_render(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", frontier.needs_render("url", "word_count", CONFIG).alias("render"))


@query(
    """SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'iso-8859-2' WHEN url LIKE 'https://%' THEN 'utf-8'
  WHEN url LIKE '%example.net%' THEN 'utf-8' ELSE 'cp1252' END AS charset, TRUE AS same FROM pages"""
)
def charset_detect(spark, sf_dir):
    """Charset from header, document head, or byte validity; decoding gives the title back."""
    url = F.col("url")
    bare = F.replace("html", F.lit('charset="utf-8"'), F.lit(""))
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    ascii_title = F.regexp_replace(title, r"[^\x00-\x7f]", "")
    body = (
        F.when(url.startswith("https://"), F.col("html").cast("binary"))
        .when(F.contains(url, F.lit("example.net")), bare.cast("binary"))
        .otherwise(F.concat(F.encode(F.regexp_replace(bare, r"[^\x00-\x7f]", ""), "US-ASCII"), F.unhex(F.lit("E9"))))
    )
    header = F.when(url.endswith(".html"), "text/html; Charset='iso-8859-2'")
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), ascii_title.alias("plain"), body.alias("body"), header.alias("header"))
    rows = rows.withColumn("charset", X.charset_of("header", "body")).withColumn("decoded", X.decode_body("body", "charset"))
    found = F.contains("decoded", F.regexp_extract("title", r"([A-Za-z]+)", 1))
    return rows.select("page_id", "charset", found.alias("same"))


@query(
    "WITH " + SQL_MAIN + f""", v AS (SELECT *, url AS u FROM main), {sql_canonical('v', 'c')}
SELECT substr(sha256(text), 1, 32) AS id, url, canon AS requested_url, canon AS canonical_url, 'web_page' AS source_type, 'text/html' AS content_type,
  {sql_unescape("regexp_extract(html, '<title>(.*?)</title>', 1)").replace("regexp_extract", "trim(regexp_extract", 1).replace("</title>', 1)", "</title>', 1))", 1)} AS title,
  sha256(text) AS content_hash, CASE WHEN page_id % 2 = 0 THEN 'Tue, 02 Jan 2024 00:00:00 GMT' ELSE '2023-05-0' || (page_id % 9 + 1) END AS modified_at,
  '2023-05-0' || (page_id % 9 + 1) AS sitemap_lastmod, 200 AS http_status FROM c"""
)
def document_assemble(spark, sf_dir):
    from ..functions.urls import canonical_url

    pid = F.col("page_id")
    headers = F.when(pid % 2 == 0, F.create_map(F.lit("Last-Modified"), F.lit("Tue, 02 Jan 2024 00:00:00 GMT"))).otherwise(
        F.create_map(F.lit("Server"), F.lit("x"))
    )
    pages = parsed(spark, sf_dir).withColumns({
        "requested_url": canonical_url("url"), "canonical_url": canonical_url("url"), "headers": headers,
        "sitemap_lastmod": F.concat(F.lit("2023-05-0"), (pid % 9 + 1).cast("string")), "http_status": F.lit(200),
        "content_type": F.lit(""), "crawled_at": F.lit("2024-02-01T00:00:00+00:00"), "depth": F.lit(0), "js_rendered": F.lit(False),
    })
    return D.page_documents(pages).select(
        "id", "url", "requested_url", "canonical_url", "source_type", "content_type", "title", "content_hash", "modified_at",
        "sitemap_lastmod", "http_status",
    )


@query(
    """WITH a AS (SELECT doc_id, 'https://files.example.com/' || source || '/f' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '' ELSE '.docx' END AS url,
  CASE lang WHEN 'de' THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type, trim(text, ' ' || chr(10)) AS body, lang FROM documents),
 b AS (SELECT *, CASE WHEN lang IN ('en', 'de') THEN body WHEN lang = 'fr' THEN 'pdf ' || doc_id ELSE '' END AS text FROM a)
SELECT url, split_part(url, '/', -1) AS title, text, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count,
  sha256(CASE WHEN text <> '' THEN text ELSE url END) AS content_hash, text = '' AS needs_extraction,
  'assets/' || substr(sha1(url), 1, 16) || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.bin' ELSE '.docx' END AS local_path FROM b"""
)
def asset_document(spark, sf_dir):
    lang = F.col("lang")
    suffix = F.when(lang == "en", ".txt").when(lang == "fr", ".pdf").when(lang == "de", "").otherwise(".docx")
    url = F.concat(F.lit("https://files.example.com/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), suffix)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", url.alias("url"), url.alias("requested_url"), F.when(lang == "de", "text/plain").otherwise("application/octet-stream").alias("content_type"),
        F.col("text").cast("binary").alias("body"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    text = D.asset_text("body", "content_type", "url", F.concat(F.lit("pdf "), F.col("doc_id").cast("string")))
    docs = D.asset_documents(rows.withColumn("text", text), "assets")
    return docs.select("url", "title", "text", "word_count", "content_hash", "needs_extraction", "local_path")


@query(
    "WITH " + SQL_MAIN + """ SELECT page_id, sha256(text) AS content_hash, text <> '' AND
  row_number() OVER (PARTITION BY sha256(text) ORDER BY page_id) > 1 AS is_duplicate FROM main"""
)
def page_dedup(spark, sf_dir):
    pages = parsed(spark, sf_dir).select("page_id", "url", S.content_hash("text").alias("content_hash"))
    return S.mark_duplicates(pages, ["page_id"]).select("page_id", "content_hash", "is_duplicate")
