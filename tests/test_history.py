"""As-of joins, version intervals, grouped reports, sketches and variants against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from siltstone.functions import variants as VA
from siltstone.operators import history as HI
from siltstone.operators import rollups as R
from siltstone.operators import sketches as SK

START = dt.datetime(2024, 1, 1)


def moment(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def crawl():
    """One key holds most rows, times repeat, some keys and times are null."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    versions = [(key(), moment(rng.choice([None, *range(0, 9000, 7)])), i, rng.choice(["x", "y", None])) for i in range(600)]
    events = [(key(), moment(rng.choice([None, *range(0, 9000, 7)])), i) for i in range(500)]
    return versions, events + events[:20]


def test_as_of_join_against_a_scan(spark, crawl):
    versions, events = crawl
    v = spark.createDataFrame(versions, "url string, at timestamp, version long, content string")
    e = spark.createDataFrame(events, "url string, at timestamp, event long")
    got = HI.as_of_join(e, v, ["url"], "at", ["version", "content"], tie="version", cell=3600)

    def live(url, at):
        held = [(a, n, c) for u, a, n, c in versions if url is not None and at is not None and u == url and a is not None and a <= at]
        return max(held, key=lambda h: h[:2])[1:] if held else (None, None)

    want = sorted(((*row, *live(row[0], row[1])) for row in events), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert HI.as_of_join(e.limit(0), v, ["url"], "at", ["version"]).count() == 0
    assert HI.as_of_join(e, v.limit(0), ["url"], "at", ["version"]).filter("version IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        HI.as_of_join(e, e, ["url"], "at", ["event"])


def test_as_of_join_makes_no_cross_join(spark, crawl):
    versions, events = crawl
    v = spark.createDataFrame(versions, "url string, at timestamp, version long, content string")
    e = spark.createDataFrame(events, "url string, at timestamp, event long")
    plan = HI.as_of_join(e, v, ["url"], "at", ["version"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("cell", [600, 86_400, 10**7])
def test_version_intervals_against_a_walk(spark, crawl, cell):
    versions, _ = crawl
    v = spark.createDataFrame(versions, "url string, at timestamp, version long, content string")
    got = sorted((tuple(r) for r in HI.version_intervals(v, ["url"], "at", "content", "version", cell).collect()), key=repr)
    want = []
    for url in {u for u, *_ in versions if u is not None}:
        rows = sorted((a, n, c) for u, a, n, c in ((u, a, n, str(c)) for u, a, n, c in versions) if u == url and a is not None)
        runs = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]]
        for i, (a, _, c) in enumerate(runs):
            want.append((url, None if c == "None" else c, a, runs[i + 1][0] if i + 1 < len(runs) else None))
    assert got == sorted(want, key=repr)


def test_rollup_tells_null_from_total(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("a", None), (None, "x")], "host string, section string")
    got = {(r.level, r.host, r.section): (r.n, r.distinct_section, r.pct, r.pct_parent) for r in R.rollup_report(rows, ["host", "section"]).collect()}
    assert got == {
        (3, None, None): (4, 1, 100.0, None), (1, "a", None): (3, 1, 75.0, 75.0), (1, None, None): (1, 1, 25.0, 25.0),
        (0, "a", "x"): (1, 1, 25.0, 33.333333), (0, "a", None): (2, 0, 50.0, 66.666667), (0, None, "x"): (1, 1, 25.0, 100.0),
    }
    assert R.rollup_report(rows.limit(0), ["host", "section"]).isEmpty()


def test_merged_sketches_equal_those_built_at_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i % 3}" if i % 7 else None, dt.date(2024, 1, 1 + i % 4), [f"t{min(rng.randrange(900), rng.randrange(900))}" for _ in range(40)], rng.randrange(5000)) for i in range(900)]
    docs = spark.createDataFrame(rows, "section string, day date, terms array<string>, words long")
    parts, once = str(tmp_path / "parts"), str(tmp_path / "once")
    SK.store_days(docs.filter("day < '2024-01-03'"), parts)
    SK.store_days(docs.filter("day >= '2024-01-03'"), parts)
    SK.store_days(docs.filter("day = '2024-01-04'"), parts)  # a day that comes again replaces itself
    SK.store_days(docs.withColumn("day", F.lit(None).cast("date")), once)
    a, b = ({r.section: r for r in SK.report(spark, p, ["section"]).collect()} for p in (parts, once))
    assert a.keys() == b.keys() == {"s0", "s1", "s2", None}
    for section, row in a.items():
        mine = [r for r in rows if r[0] == section]
        words, terms = sorted(r[3] for r in mine), [t for r in mine for t in r[2]]
        for found in (row, b[section]):
            assert (found.documents, found.words, found.least, found.most, found.occurrences) == (len(mine), sum(words), words[0], words[-1], len(terms))
            assert abs(found.terms - len(set(terms))) <= SK.DISTINCT_ERROR * len(set(terms))
            for value, rank in ((found.q50, 0.5), (found.q90, 0.9)):
                assert sum(w <= value for w in words) / len(words) >= rank - SK.RANK_ERROR
                assert sum(w < value for w in words) / len(words) <= rank + SK.RANK_ERROR
            counts = sorted((terms.count(t) for t in set(terms)), reverse=True)
            assert [t.n for t in found.top] == counts[:10]
            assert all(t.n == terms.count(t.term) for t in found.top)


def test_shredding_counts_what_is_no_json(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": "one"}'), (3, "{"), (4, None), (5, "")], "id int, body string")
    got = {r.id: (r.value, r.malformed) for r in VA.shredded(rows, "body").collect()}
    assert got[1][0].b.c == "x" and not got[1][1]
    assert [got[i][1] for i in (2, 3, 4, 5)] == [False, True, False, True]
    fields = {(r.path, r.type): r.n for r in VA.field_types(rows, "body").collect()}
    assert fields == {("$", "OBJECT"): 2, ("$", "MALFORMED"): 2, ("$.a", "BIGINT"): 1, ("$.a", "STRING"): 1, ("$.b", "OBJECT"): 1, ("$.b.c", "STRING"): 1}
    assert VA.field_types(rows.limit(0), "body").count() == 0
