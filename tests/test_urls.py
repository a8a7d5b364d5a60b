from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siltstone.functions import urls as U

CASES = [
    ("http://Ex.COM:80//a//b/index.html?b=2&a=%41&utm_Source=x#f", "http://ex.com/a/b/?a=A&b=2"),
    ("https://u:p@x.com:8443/?q=a+b&q=", "https://x.com:8443/?q=&q=a b"),
    ("  https://x.com ", "https://x.com/"),
    ("HTTP://x.com/p?ref=1&page=1", "http://x.com/p?page=1"),
    ("http://x.com/a b?x=%zz&y=%26", "http://x.com/a b?x=%zz&y=&"),
    ("https://x.com:443/index.php", "https://x.com/"),
    ("http://x.com:443/", "http://x.com:443/"),
    ("http://x.com:/a", "http://x.com/a"),
    ("http://x.com/INDEX.HTML", "http://x.com/INDEX.HTML"),
    ("http://x.com/?mc_eid=1&_hs=2&_hsenc=3&igshid&reference=1", "http://x.com/?reference=1"),
    ("http://x.com/é?k=é", "http://x.com/é?k=é"),
    ("http://x.com/a\tb", "http://x.com/ab"),
    ("", None), ("mailto:a@b.c", None), ("tel:1", None), ("#top", None), ("javascript:x", None),
    ("ftp://x.com/", None), ("/rel", None), ("http://x.com:99999/", None), ("http://x.com:8a/", None), ("http:///p", None),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_canonical(one, raw, expected):
    assert one(U.canonical_url("u"), u=raw) == expected


@pytest.mark.parametrize(
    "ref", ["../x/./y?z=1", "?p=2", "//other.org/q", "/abs/../r", "child.html", "..", "a/..", ".", "../../../up", "./", "g;x=1/../y"]
)
def test_resolution_agrees_with_the_standard_library(one, ref):
    base = "https://h.com/d/e/f.html?k=1#z"
    assert one(U.resolve_url("r", "b"), r=ref, b=base) == urljoin(base, ref)


def test_link_arrays_are_distinct_and_resolved(spark):
    df = spark.createDataFrame([(["/a", "/a#x", "mailto:q", "b?utm_id=1&utm_source=2", "//c.d/e"], "http://h.com/p/q")], "l array<string>, b string")
    got = df.select(U.canonical_urls(F.col("l"), F.col("b")).alias("r")).first().r
    assert got == ["http://h.com/a", "http://h.com/p/b", "http://c.d/e"]


@pytest.mark.parametrize(
    "url,host,ext,section",
    [
        ("https://A.b.com/x/y.PDF?z=.png", "a.b.com", ".pdf", "x"),
        ("https://u@b.com:80", "b.com", "", "(home)"),
        ("https://b.com//deep/v1.2/file", "b.com", "", "deep"),
        ("https://b.com/.hidden", "b.com", ".hidden", ".hidden"),
    ],
)
def test_parts(one, url, host, ext, section):
    assert one(F.concat_ws("|", U.url_host("u"), U.url_extension("u"), U.url_section("u")), u=url) == f"{host}|{ext}|{section}"


def test_domains_scope_and_media(one):
    inside = lambda u: one(U.in_domains("u", ["Example.com"]), u=u)
    assert [inside(u) for u in ("http://example.com/", "http://a.example.com/", "http://badexample.com/")] == [True, True, False]
    scope = lambda u: one(U.matches_scope("u", ["/docs/"], [r"[?&]s="]), u=u)
    assert [scope(u) for u in ("http://x/DOCS/a", "http://x/docs/?s=1", "http://x/blog")] == [True, False, False]
    assert one(U.is_media("u"), u="http://x/a.WOFF2") and not one(U.is_media("u"), u="http://x/a.pdf")
    assert one(U.is_asset_link("u"), u="http://x/a.PDF?v=1") and not one(U.is_asset_link("u"), u="http://x/a?f=.pdf")


@pytest.mark.parametrize("url,suffix", [("http://x/a.tar.gz?v=.pdf", ".gz"), ("http://x/a", ".bin"), ("http://x/a.verylongsuffix", ".verylongs")])
def test_asset_names(one, url, suffix):
    name = one(U.asset_file_name("u"), u=url)
    assert len(name.split(".")[0]) == 16 and name.endswith(suffix)


def test_eval_url(one):
    assert one(U.eval_url("u"), u="https://x/a/b//?q#f") == "https://x/a/b"


words = st.text("abcAZ019-_.", min_size=1, max_size=6)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(words, st.lists(words, max_size=3), st.lists(st.tuples(words, words), max_size=3)), min_size=8, max_size=20))
def test_canonical_form_is_stable(spark, parts):
    urls = [f"http://{h.strip('.-_') or 'h'}.com/{'/'.join(p)}?{'&'.join(k + '=' + v for k, v in q)}" for h, p, q in parts]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.canonical_url("u").alias("c"))
    assert df.filter(~F.col("c").eqNullSafe(U.canonical_url("c"))).isEmpty()
