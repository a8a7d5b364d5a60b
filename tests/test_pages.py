import pytest
from pyspark.sql import functions as F
from siltstone.functions import html as H
from siltstone.functions import http as X
from siltstone.functions import text as T

LONG = "word " * 60
PAGE = f"""<!doctype html><html lang=" en "><head><title>A &amp; B</title>
<meta name="description" content=" About us "><meta name="keywords" content="x, ,y ">
<meta name="robots" content="noarchive"><meta name="googlebot" content="NOINDEX,nofollow">
<meta property="article:published_time" content="2024-01-02"><link rel="alternate canonical" href="/canon?utm_source=1">
</head><body><div id="breadcrumbs"><a href="/">Home</a> <a href="/g"> Guide </a><a href="/e"></a></div>
<nav><a href="menu.html">M</a></nav>
<main><header>gone</header><div class="navigate">gone too</div><span aria-hidden="true">x</span>
<h1>Top</h1><p>first<p>second <b>bold</b></p><div>bare text</div>
<h2>Sub</h2><ul><li>one<li>two <p>inner</p></ul><table><tr><td><h3>Cell</h3>cell text</td></tr></table>
<h4></h4><p>tail  end</p><p>{LONG}</p><a href="doc.PDF?x=1">pdf</a><a href="/canon#frag">c</a><a href="/canon">again</a></main>
<script>var t = "<p>no</p>"</script></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([(PAGE, "https://h.com/dir/page")], "html string, url string").withColumn("p", H.parsed_page("html"))
    return df.select(*[c.alias(n) for n, c in H.page_columns(F.col("p"), F.col("url")).items()]).first()


def test_head_fields(page):
    assert (page.title, page.description, page.language, page.keywords) == ("A & B", "About us", "en", ["x", "y"])
    assert page.noindex and page.nofollow and page.published_at == "2024-01-02"
    assert page.canonical_url == "https://h.com/canon"


def test_links_breadcrumbs_and_assets(page):
    assert page.breadcrumbs == ["Home", "Guide"]
    assert page.assets == ["https://h.com/dir/doc.PDF?x=1"]
    assert page.links == ["https://h.com/", "https://h.com/g", "https://h.com/e", "https://h.com/dir/menu.html", "https://h.com/canon"]


def test_sections_group_blocks_under_headings(page):
    # The table cell's text precedes its own heading's section; an empty heading keeps the last name.
    assert [(s.heading, s.level) for s in page.sections] == [("Top", 1), ("Sub", 2), ("Cell", 4)]
    assert page.sections[0].text == "first\nsecond bold"
    assert page.sections[1].text.startswith("one\ntwo inner")
    assert page.headings == ["Top", "Sub", "Cell"]


def test_text_keeps_bare_div_text_and_drops_boilerplate(page):
    assert "bare text" in page.text and "gone" not in page.text and "var t" not in page.text
    assert "tail end" in page.text and page.word_count == len(page.text.split())


def test_short_main_falls_back_to_body(spark):
    html = "<html><body><main>short</main><footer>f</footer><p>outside</p></body></html>"
    df = spark.createDataFrame([(html, "https://h.com/")], "html string, url string").withColumn("p", H.parsed_page("html"))
    row = df.select(*[c.alias(n) for n, c in H.page_columns(F.col("p"), F.col("url")).items()]).first()
    assert row.text == "short\noutside" and row.sections[0].heading == "Overview"


def test_broken_and_empty_html_survive(spark):
    df = spark.createDataFrame([(None,), ("",), ("<p><b>x</i></p></div><li>",)], "html string")
    assert [r.t for r in df.select(H.parsed_page("html")["raw_text"].alias("t")).collect()] == ["", "", "x"]


@pytest.mark.parametrize(
    "header,body,expected",
    [
        ("text/html; charset='ISO-8859-2'", b"x", "ISO-8859-2"),
        ("text/html", b'<meta charset="koi8-r">', "koi8-r"),
        ("", "é".encode(), "utf-8"),
        (None, b"caf\xe9", "cp1252"),
    ],
)
def test_charset(spark, header, body, expected):
    df = spark.createDataFrame([(header, bytearray(body))], "h string, b binary").withColumn("c", X.charset_of("h", "b"))
    row = df.withColumn("d", X.decode_body("b", "c")).first()
    assert row.c == expected and "�" not in row.d


def test_robots_rules(spark):
    text = "User-agent: siltstone\nDisallow: /private\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /\nSitemap: https://x/s.xml # c\n"
    rows = [(text, 200, "https://x/private/a"), (text, 200, "https://x/open"), (None, 403, "https://x/"), (None, 404, "https://x/"), (None, None, "https://x/")]
    df = spark.createDataFrame(rows, "r string, s int, u string")
    allowed = [r.a for r in df.select(X.robots_allows("siltstone/1.0")("r", "s", "u").alias("a")).collect()]
    assert allowed == [False, True, False, True, True]
    first = df.select(X.robots_crawl_delay("siltstone/1.0")("r", "s").alias("d"), X.robots_sitemaps("r").alias("m")).first()
    assert (first.d, first.m) == (3.0, ["https://x/s.xml"])


def test_backoff(one):
    wait = lambda attempt, after: one(X.backoff_seconds(F.lit(attempt), F.col("a")), a=after)
    assert [wait(0, None), wait(3, "soon"), wait(9, None), wait(0, "7"), wait(0, "900")] == [1.0, 8.0, 60.0, 7.0, 60.0]


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
     ("agreed", "agre"), ("happy", "happi"), ("sky", "sky"), ("electrical", "electr"), ("adoption", "adopt"), ("controlling", "control"),
     ("rate", "rate"), ("cease", "ceas"), ("user's", "user"), ("generalizations", "gener"), ("by", "by")],
)
def test_porter(word, stem, one):
    assert one(T.english_stem("w"), w=word) == stem


def test_text_helpers(one):
    assert one(T.squeeze("t"), t=" a \t  b\n\n\n\nc ") == "a b\n\nc"
    assert one(T.word_count("t"), t="a b  c\n") == 3
    assert [one(T.token_count("t"), t="w " * n) for n in (0, 1, 5, 15)] == [1, 1, 6, 20]
    assert one(T.report_terms("t"), t="The quick-fox isn't THREE now x9") == ["quick-fox"]
    assert one(F.array_join(T.bigrams(T.report_terms("t")), ","), t="alpha beta the gamma") == "alpha beta,beta gamma"
    assert one(T.bar(F.lit(1), F.lit(1000)), t="") == "#" and one(T.bar(F.lit(0), F.lit(5)), t="") == ""


def test_one_odd_page_spoils_nothing(spark):
    from siltstone.functions import http as X

    rows = [(1, "<p>a<![foo[x]]>b</p>", "idna"), (2, "<p>plain</p>", "utf-8"), (3, None, "undefined")]
    df = spark.createDataFrame(rows, "id int, html string, charset string")
    got = {r.id: r for r in df.select("id", H.parsed_page("html").alias("p"), X.decode_body(F.encode("html", "utf-8"), "charset").alias("text")).collect()}
    assert got[1].p.error is None and got[1].p.raw_text == "ab" and got[2].p.raw_text == "plain"
    assert [got[i].text for i in (1, 2, 3)] == [rows[0][1], rows[1][1], None]
    rules = spark.createDataFrame([("User-agent: *\nDisallow: /x", 200, u) for u in ("http://a%5B.example.com/", "http://a.com/x", "http://a.com/y")], "t string, s int, u string")
    assert [r[0] for r in rules.select(X.robots_allows("bot")("t", "s", "u")).collect()] == [False, False, True]


def test_scripts_do_not_make_main_content():
    script = "<script>" + "x" * 400 + "</script>"
    page = H.parse_page(f"<body><main>{script}short</main><div>{'body text ' * 40}</div></body>")
    assert "body text" in page["raw_text"]
    same = "words " * 60
    assert H.parse_page(f"<body><article>{same}first</article><main>{same}other</main></body>")["raw_text"].endswith("other")


@pytest.mark.parametrize("cut, text", [
    ("a &amp;&amp;&amp", "a &&&amp"), ("a &ampb; &am &copy", "a &ampb; &am &copy"), ("&copy; &#39; &eacute; &#x41; &nosuch; &", "© ' é A &nosuch; &"),
])
def test_only_whole_references_stand_for_characters(cut, text):
    fields = H.parse_page(f"<title>{cut}</title><body><h1>{cut}</h1><a href='/?a=1&copy=2&amp;b=3'>x</a>")
    assert (fields["title"], fields["headings"], fields["hrefs"]) == (text, [text], ["/?a=1&copy=2&b=3"])


def test_pages_are_parsed_once_in_small_batches(spark):
    pages = spark.createDataFrame([(PAGE, "https://h.com/")], "html string, url string").withColumn("p", H.parsed_page("html"))
    links = pages.select(F.explode(H.page_columns(F.col("p"), F.col("url"))["links"]).alias("link"))
    assert links._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_page_queries_read_cut_references_as_the_sql_does(spark, tmp_path):
    """crawl_pages, document_assemble and html_main_text over pages whose texts end inside a reference."""
    import oracle
    from siltstone.plans.catalog import load_all

    body = "word " * 60
    rows = [(i, f"https://www.example.com/p{i}", f"<html lang=\"en\"><head><title>t{i} &amp;&amp{end}</title></head><body><article><h1>h &copy{end}</h1><p>{body}&amp;&am{end}</p></article></body></html>")
            for i, end in enumerate(("", "p", ";", "b;", "p;"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = oracle.duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("crawl_pages", "document_assemble", "html_main_text"):
        query = load_all()[name]
        assert oracle.compare(query.run(spark, str(tmp_path)), duck, query.sql) == []
