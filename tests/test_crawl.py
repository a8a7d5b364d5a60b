import gzip

import pytest
from pyspark.sql import functions as F
from siltstone.config import CrawlConfig, load_crawl_config
from siltstone.operators import frontier as FR
from siltstone.operators import sitemaps as SM
from siltstone.plans.crawl import Crawl, warn_if_partial
from siltstone.sources import jsonl, tables
from siltstone.sources.fetch import http_fetch, table_fetch

BODY = "<p>" + "plain words here " * 30 + "</p>"


def html(title, links="", extra="", head=""):
    return f"<html><head><title>{title}</title>{head}</head><body>{links}{BODY}<p>{extra}</p></body></html>".encode()


def site(changed=False):
    ok = {"Content-Type": "text/html; charset=utf-8"}
    links = "".join(f'<a href="{u}">x</a>' for u in ("/a", "/b?utm_source=q", "/dup", "/moved", "/gone", "/hidden", "/private/x", "/doc.txt", "/pic.png",
                                                    "https://else.org/", "/skipme", "/loop", "/zip"))
    return [
        ("https://s.com/robots.txt", 200, {"Content-Type": "text/plain"}, b"User-agent: *\nDisallow: /private\nSitemap: https://s.com/map.xml\n"),
        ("https://s.com/map.xml", 200, {}, gzip.compress(b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s.com/</loc>'
                                                         b'<lastmod>2024-01-01</lastmod></url><url><loc>/deep</loc></url></urlset>')),
        ("https://s.com/", 200, ok | {"ETag": "v1"}, html("Home", links, "home")),
        ("https://s.com/deep", 200, ok, html("Deep", "", "deep")),
        ("https://s.com/a", 200, ok, html("A", '<a href="/a2">n</a>', "changed text" if changed else "page a")),
        ("https://s.com/a2", 200, ok, html("A2", '<a href="/too-deep">n</a>', "page a2")),
        ("https://s.com/b", 200, ok, html("B", "", "page b")),
        ("https://s.com/dup", 200, ok, html("Dup", "", "page b")),
        ("https://s.com/moved", 301, {"Location": "/target"}, b""),
        ("https://s.com/target", 200, ok, html("Target", "", "target")),
        ("https://s.com/loop", 302, {"Location": "https://else.org/x"}, b""),
        ("https://s.com/hidden", 200, ok | {"X-Robots-Tag": "NoIndex"}, html("Hidden", '<a href="/from-hidden">n</a>', "hidden")),
        ("https://s.com/doc.txt", 200, {"Content-Type": "text/plain"}, b" asset text \n"),
        ("https://s.com/zip", 200, {"Content-Type": "application/zip"}, b"PK"),
    ]


@pytest.fixture
def setup(spark, tmp_path):
    def run(run_id, changed=False, **over):
        config = CrawlConfig(**({"seeds": ["https://s.com/#top"], "allowed_domains": ["s.com"], "exclude_patterns": ["/skipme"], "max_depth": 2,
                                 "output_dir": str(tmp_path / "out"), "state_db": str(tmp_path / "state")} | over))
        pages = spark.createDataFrame(site(changed), "url string, status int, headers map<string,string>, content binary")
        return config, Crawl(spark, config, table_fetch(pages), run_id, f"2024-02-0{run_id}T00:00:00+00:00").run()

    return run


def decided(result):
    out = {}
    for r in result.decisions.filter("decision NOT IN ('queued')").collect():
        out.setdefault(r.decision, set()).add(r.url.removeprefix("https://s.com"))
    return out


def test_two_runs(spark, setup, tmp_path):
    config, first = setup("1")
    got = decided(first)
    assert got["indexed"] == {"/", "/deep", "/a", "/a2", "/b", "/moved"}
    assert got["duplicate_content"] == {"/dup"} and got["noindex"] == {"/hidden"} and got["skipped_robots"] == {"/private/x"}
    assert got["http_error"] == {"/gone"} and got["redirect_not_followed"] == {"/loop"} and got["unsupported_media"] == {"/zip"}
    assert got["asset"] == {"/doc.txt"} and got["skipped_media"] == {"/pic.png"} and got["skipped_scope"] == {"/skipme"}
    stats = first.stats.first()
    assert (stats.indexed, stats.duplicates, stats.errors, stats.assets, stats.skipped_media) == (6, 1, 1, 1, 2)

    docs = {r.requested_url.removeprefix("https://s.com"): r for r in jsonl.read_documents(spark, config.output_dir).collect()}
    assert docs["/moved"].url == "https://s.com/target" and docs["/"].sitemap_lastmod == "2024-01-01" == docs["/"].modified_at
    assert docs["/doc.txt"].text == "asset text" and docs["/doc.txt"].source_type == "linked_document" and docs["/doc.txt"].depth == 1
    assert (tmp_path / "out" / "assets").exists() and len(list((tmp_path / "out" / "assets").iterdir())) == 1
    state = {r.url.removeprefix("https://s.com"): r for r in tables.read_snapshot(spark, config.state_db).collect()}
    assert (state["/"].etag, state["/"].error, state["/gone"].error, state["/dup"].error) == ("v1", None, "http_404", "duplicate")

    _, second = setup("2", changed=True)
    got = decided(second)
    # The home page answers 304, so its links are not seen again; the sitemap page is unchanged.
    assert got == {"unchanged_304": {"/"}, "unchanged_hash": {"/deep"}}
    again = {r.url.removeprefix("https://s.com"): r for r in second.state.collect()}
    assert again["/"].first_seen.startswith("2024-02-01") and again["/"].last_crawled.startswith("2024-02-02") and again["/"].title == "Home"


def test_full_run_keeps_one_of_two_copies(setup):
    over = {"max_depth": 0, "seeds": ["https://s.com/b", "https://s.com/dup"], "follow_links": False}
    setup("1", **over)
    _, again = setup("2", incremental=False, **over)
    assert decided(again)["indexed"] == {"/", "/deep", "/b"} and decided(again)["duplicate_content"] == {"/dup"}
    assert again.state.filter("url = 'https://s.com/b'").first().first_seen.startswith("2024-02-01")


def test_budget(setup):
    _, result = setup("1", max_pages=1, max_depth=0)
    assert result.stats.first().fetched == 1


def test_rendering_thin_pages(spark, tmp_path):
    config = CrawlConfig(seeds=["https://s.com/"], allowed_domains=["s.com"], max_depth=0, output_dir=str(tmp_path / "o"), state_db=str(tmp_path / "s"))
    pages = spark.createDataFrame([("https://s.com/", 200, {"Content-Type": "text/html"}, b"<body>thin</body>")], "url string, status int, headers map<string,string>, content binary")
    render = lambda url: F.concat(F.lit("<body><p>rendered "), url, F.lit("</p></body>"))
    result = Crawl(spark, config, table_fetch(pages), "1", "2024", render).run()
    row = result.documents.first()
    assert row.text == "rendered https://s.com/" and row.js_rendered and result.stats.first().rendered == 1


def test_http_fetch_retries_and_reports_failures(spark):
    def transport(url, headers, timeout, limit):
        if url.endswith("/down"):
            raise TimeoutError
        if url.endswith("/busy"):
            return 503, {"Retry-After": "1"}, b""
        return 200, {"Content-Type": "text/html; charset=x-y", "Seen": headers.get("If-None-Match", "")}, b"body"

    config = CrawlConfig(seeds=["x"], allowed_domains=["x"], max_retries=1)
    requests = spark.createDataFrame([(f"http://x/{p}", "tag", None, 0.0) for p in ("ok", "down", "busy")], "url string, etag string, last_modified string, start_at double")
    got = {r.url[9:]: r for r in http_fetch(config, transport, sleep=lambda s: None)(requests).collect()}
    assert (got["ok"].status, got["ok"].encoding, got["ok"].headers["seen"], bytes(got["ok"].content)) == (200, "x-y", "tag", b"body")
    assert got["down"].error == "network_error: TimeoutError" and got["busy"].status == 503


def test_a_host_is_never_asked_back_to_back(spark, tmp_path):
    log = tmp_path / "times"
    log.mkdir()

    def transport(url, headers, timeout, limit):
        import pathlib
        import time

        pathlib.Path(log, f"{time.time():.4f}-{url.rsplit('/', 1)[1]}").touch()
        time.sleep(0.12 if url.endswith("/3") else 0)
        return 200, {}, b"x" * 40

    config = CrawlConfig(seeds=["x"], allowed_domains=["x"], max_content_bytes=30)
    rows = [(f"http://h{i % 2}/{i}", None, None, 0.05 * (i // 2), 0.05) for i in range(20)]
    requests = spark.createDataFrame(rows, "url string, etag string, last_modified string, start_at double, delay double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = http_fetch(config, transport)(requests).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 20 and all(r.truncated and len(r.content) == 30 for r in got)
    for host in (0, 1):
        times = sorted(float(n.split("-")[0]) for n in (p.name for p in log.iterdir()) if int(n.split("-")[1]) % 2 == host)
        assert min(b - a for a, b in zip(times, times[1:])) > 0.045


def test_robots_and_sitemaps_behind_redirects(spark, tmp_path):
    ok = {"content-type": "text/html"}
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    pages = [
        ("http://s.com/robots.txt", 301, {"Location": "https://www.s.com/robots.txt"}, b""),
        ("https://www.s.com/robots.txt", 200, {}, b"User-agent: *\nDisallow: /no\nSitemap: http://s.com/map.xml\n"),
        ("http://s.com/map.xml", 301, {"location": "http://cdn.org/map2.xml"}, b""),
        ("http://cdn.org/map2.xml", 200, {}, f"<urlset {ns}><url><loc>http://s.com/inmap</loc></url></urlset>".encode()),
        ("http://s.com/", 200, ok, html("Home", '<a href="/no">n</a><a href="/hop0">h</a><a href="http://a%5B.s.com/">b</a>')),
        ("http://s.com/inmap", 200, ok, html("In", "", "map")), ("http://s.com/no", 200, ok, html("No", "", "no")),
        *[(f"http://s.com/hop{i}", 302, {"Location": f"/hop{i + 1}"}, b"") for i in range(5)],
    ]
    table = spark.createDataFrame(pages, "url string, status int, headers map<string,string>, content binary")
    config = CrawlConfig(seeds=["http://s.com/"], allowed_domains=["s.com"], max_depth=1, max_redirects=2, output_dir=str(tmp_path / "o"), state_db=str(tmp_path / "s"))
    result = Crawl(spark, config, table_fetch(table), "1", "2024").run()
    got = {}
    for r in result.decisions.filter("decision <> 'queued'").collect():
        got.setdefault(r.decision, set()).add(r.url)
    assert got["indexed"] == {"http://s.com/", "http://s.com/inmap"} and got["skipped_robots"] == {"http://s.com/no"}
    assert got["redirect_limit"] == {"http://s.com/hop0"}
    assert result.state.filter("url = 'http://s.com/hop0'").first().error == "redirect_not_followed"


def test_redirect_chains(spark):
    rows = [("http://x/a", 301, "/b"), ("http://x/b", 302, "c"), ("http://x/c", 200, None), ("http://x/self", 301, "/self#f"), ("http://x/no", 301, None),
            ("http://x/off", 301, "http://y/"), *[(f"http://x/{i}", 301, f"/{i + 1}") for i in range(9)]]
    hops = spark.createDataFrame(rows, "url string, status int, location string")
    got = {r.url[9:]: (r.final_url[9:], r.status, r.hops) for r in FR.follow_redirects(hops.select("url"), hops, F.col("target").startswith("http://x/")).collect()}
    assert got["a"] == ("c", 200, 2) and got["self"] == ("self", 301, 0) and got["no"] == ("no", 301, 0) and got["off"] == ("off", 301, 0)
    assert got["0"] == ("5", 301, 5)


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    files = [("http://x/i.xml", f"<sitemapindex {ns}><sitemap><loc>/a.xml.gz</loc></sitemap><sitemap><loc>i.xml</loc></sitemap><sitemap><loc>bad.xml</loc></sitemap></sitemapindex>".encode()),
             ("http://x/a.xml.gz", gzip.compress(f"<urlset {ns}><url><loc>/1?utm_source=a</loc><lastmod>2024</lastmod></url><url><loc>/1</loc></url><url/></urlset>".encode())),
             ("http://x/bad.xml", b"<urlset><url>"), ("http://x/other.xml", f"<urlset {ns}><url><loc>/unreached</loc></url></urlset>".encode())]
    df = spark.createDataFrame(files, "url string, content binary")
    roots = spark.createDataFrame([("http://x/i.xml",)], "url string")
    assert [tuple(r) for r in SM.discover(df, roots).collect()] == [("http://x/1", "2024")]
    assert SM.discover(df, roots, max_sitemaps=1).isEmpty()


def test_damaged_and_deep_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    whole = bytearray(gzip.compress(f"<urlset {ns}><url><loc>/1</loc></url></urlset>".encode()))
    whole[12] ^= 0xFF
    deep = 60
    files = [(f"http://x/{i}.xml", f"<sitemapindex {ns}><sitemap><loc>/{i + 1}.xml</loc></sitemap></sitemapindex>".encode()) for i in range(deep)]
    files += [(f"http://x/{deep}.xml", f"<urlset {ns}><url><loc>/end</loc></url></urlset>".encode()), ("http://x/broken.gz", bytes(whole))]
    df = spark.createDataFrame(files, "url string, content binary")
    assert SM.parse_sitemaps(df).filter("sitemap_url LIKE '%broken%'").isEmpty()
    few = SM.discover(df.filter(f"url >= 'http://x/{deep - 3}' OR url LIKE '%6_.xml'"), spark.createDataFrame([(f"http://x/{deep - 3}.xml",)], "url string"))
    assert [r.url for r in few.collect()] == ["http://x/end"]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("seeds: [http://a/]\nallowed_domains: [a]\nmax_depth: 3\n")
    assert load_crawl_config(path, max_pages=7).max_pages == 7
    path.write_text("seeds: [http://a/]\nallowed_domains: [a]\nbogus: 1\n")
    with pytest.raises(ValueError, match="bogus"):
        load_crawl_config(path)
    for bad in ({"seeds": ["x"]}, {"allowed_domains": ["a"]}, {"seeds": ["x"], "allowed_domains": ["a"], "render_js": "maybe"}):
        with pytest.raises(ValueError):
            CrawlConfig(**bad)


def test_partial_corpus_warning(spark, tmp_path):
    config = CrawlConfig(seeds=["x"], allowed_domains=["a"], output_dir=str(tmp_path / "none"), state_db=str(tmp_path / "st"))
    assert warn_if_partial(spark, config) is None
    tables.write_snapshot(spark.createDataFrame([("u",)], "url string"), config.state_db)
    assert "1 URLs" in warn_if_partial(spark, config)


def test_redirect_steps_hold_no_copy_of_the_responses(spark):
    from siltstone.operators import frontier

    hops = spark.createDataFrame([("https://a.com/1", 301, "/2"), ("https://a.com/2", 200, None)], "url string, status int, location string")
    walked = frontier.follow_redirects(hops.select("url"), hops)
    assert sorted(tuple(r) for r in walked.collect()) == [("https://a.com/1", "https://a.com/2", 200, 1), ("https://a.com/2", "https://a.com/2", 200, 0)]
    assert "Broadcast" not in walked._jdf.queryExecution().executedPlan().toString()
