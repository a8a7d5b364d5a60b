"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from siltstone.llm import byte_bpe, fingerprints, language, packing, quality, sharding, simhash_dedup, substring_dedup, toxicity, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PLAIN = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 9973}x{i % 31}" for i in range(120_000))
ROWS = [
    (1, PLAIN, "en", "a", 5), (1, PLAIN, "en", "a", 5), (2, PLAIN, None, None, None), (3, None, "en", "a", 0),
    (4, "", "en", "a", 0), (5, " \t\n", None, "a", 3), (6, LONG, "fr", "b", 1), (None, "no id here", "en", "b", 2),
    (None, None, None, None, None), (7, "12 34 !!", "en", "c", 8), (8, "é", "fr", "c", 1), (9, "MiXeD Case", "de", "c", 10),
]
CLASHING = [
    "id", "key", "row", "shard", "slot", "rank", "number", "text_key", "sequence", "doc", "words", "lines", "fingerprint",
    "component_id", "piece", "twin", "range", "to", "ahead", "found", "kept", "n_words", "starts", "node", "first", "cell",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return frame.select("*", *[F.lit("x").alias(name) for name in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 0, 0), (None, 0, 1), (9, None, None), (8, 7, 7)], "doc_id long, quality int, toxic int")


def by_text(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows]


def test_near_duplicates(odd, none):
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    blank = {r.component_id for r in rows if r.fingerprint == 0}
    assert blank == {3} and sum(r.fingerprint == 0 for r in rows) == 4
    assert [r.component_id for r in rows if r.id in (1, 2)] == [1, 1, 1]
    assert simhash_dedup.near_duplicates(none).collect() == []


def test_similar_documents(odd, none):
    rows = simhash_dedup.similar_documents(odd).collect()
    assert len(rows) == len(ROWS) and [r.component_id for r in rows if r.id in (1, 2)] == [1, 1, 1]
    assert simhash_dedup.similar_documents(none).collect() == []


def test_byte_bpe(odd, none):
    rows = byte_bpe.round_trips(odd, RANKS).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert sorted(r.decoded_sha256 for r in rows) == want
    assert sorted(r.n_tokens for r in rows if r.id in (3, 4)) == [0, 0]
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, RANKS), RANKS)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert byte_bpe.round_trips(none, RANKS).collect() == []


def test_quality(odd, none, labels):
    rows = quality.filter_quality(odd, labels).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_words for r in rows if r.id in (3, 4, 5)} == {0} and not any(r.kept for r in rows if r.n_words < 20)
    assert all(r.kept for r in rows if r.id in (1, 2))
    assert quality.filter_quality(none, labels).collect() == []
    assert quality.filter_quality(odd, labels.limit(0)).filter("rule is not null").count() == 0


def test_toxicity(odd, none, labels):
    model = toxicity.train(odd.select("doc_id", "text").join(labels, "doc_id"))
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.id in (3, 4)} == {0.0}
    assert toxicity.score_documents(none, model).collect() == []
    assert toxicity.train(none.withColumn("toxic", F.lit(0))).weights == {}


def test_sharding(odd, none):
    rows = sharding.shard_documents(odd, shards=3).collect()
    assert sorted(by_text(rows, "shard", "slot")) == sorted((s, i) for s, n in enumerate([4, 4, 4]) for i in range(n))
    assert len({r.shard for r in rows if r.id in (1, 2)}) == 1
    assert {r.size for r in rows if r.id in (3, 4)} == {16}
    assert sharding.shard_documents(none).collect() == []


def test_packing(odd, none):
    rows = packing.pack(odd, WORDS).collect()
    assert len({(r.id, r.ids_crc32, r.sequence_id, r.offset) for r in rows}) == len(rows)
    long = sorted((r.piece, r.start, r.length) for r in rows if r.id == 6)
    assert all(n == 4096 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [4096 * i for i in range(len(long))]
    assert [r.length for r in rows if r.id in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack(none, WORDS).collect() == []


def test_substrings(odd, none):
    rows = substring_dedup.remove_repeats(odd, carry=["doc_id", "sequence"]).collect()
    assert sorted(by_text(rows, "id", "n_words", "n_removed"), key=str) == sorted(
        [(1, 60, 60), (1, 60, 60), (2, 60, 60), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 120_000, 0), (None, 3, 0), (None, 0, 0), (7, 3, 0), (8, 1, 0), (9, 2, 0)],
        key=str,
    )
    assert all(r.doc.sequence == "x" for r in rows)
    assert substring_dedup.remove_repeats(none).collect() == []


def test_language(odd, none):
    model = language.train(odd, sample_rows=1000)
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ROWS)
    assert {r.id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 7, None}
    assert language.identify(none, model).collect() == []
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_fingerprints(odd, none):
    rows = fingerprints.edited_likeness(odd).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({bytes(r.fingerprint) for r in rows if r.id in (1, 2)}) == 1
    assert fingerprints.edited_likeness(none).collect() == []


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow")], "rule_host string, rule_path string, verdict string")
    pages = spark.createDataFrame(
        [(1, "HTTP://A.Com/x?y", "<a href='http://b.org/'>"), (1, "HTTP://A.Com/x?y", None), (None, None, ""), (2, "", "x"), (3, "http://com", "")],
        "page_id long, url string, html string",
    ).select("*", *[F.lit("x").alias(name) for name in ("id", "host", "path", "rule", "verdict", "link", "source", "target")])
    rows = url_filter.filter_urls(pages, rules).collect()
    assert sorted(by_text(rows, "id", "host", "path", "rule", "verdict"), key=str) == sorted(
        [(1, "a.com", "/x", "com/", "allow")] * 2 + [(None, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "com", "", None, "allow")], key=str
    )
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = stage(spark, odd, str(tmp_path))
    assert stage(spark, none, str(tmp_path)).collect() == []
    if name != "best_fit":
        assert left.columns == corpus_pipeline.COLUMNS
    found = sorted((r.doc_id for r in left.select("doc_id").distinct().collect()), key=str)
    wanted = {
        "quality_rules": [1, 2, 6], "language_id": [1, 2, 6, 8, 9, None], "near_dedup": [1, 3, 6, 7, 8, 9, None],
        "substring_repeats": [6, 7, 8, 9, None], "best_fit": [1, 2, 3, 4, 5, 6, 7, 8, 9, None],
    }
    assert found == sorted(wanted[name], key=str)


def test_language_stage_without_labels(spark, odd):
    left = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), "")
    assert {r.doc_id for r in left.collect()} == {1, 2, 6, 8, 9, None}


def test_language_stage_keeps_mixed_texts(spark):
    parts = {"en": "the quick brown fox jumps over the lazy dog", "fr": "le renard rapide saute par dessus le chien", "ru": "быстрая лиса прыгает через ленивую собаку"}
    rows = [(i, t, lang, "a", len(t)) for i, (lang, t) in enumerate([*parts.items()] * 5)]
    mixed, greek = f"{parts['en']}. {parts['fr']}. {parts['ru']}", "η γρήγορη καφέ αλεπού πηδά πάνω από το σκυλί"
    rows += [(100, mixed, None, "a", len(mixed)), (101, greek, None, "a", len(greek)), (102, "12 34", None, "a", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language.identify(docs, language.train(docs)).filter("id = 100").first()
    assert found.score < 0.5
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {*range(15), 100}


def test_toxicity_sample_is_bounded(spark):
    for hot in ("hot", "other", "third"):
        rows = spark.range(6000).selectExpr("id", f"if(id % 3 = 0, '{hot}', concat('text ', id)) AS text", "1 AS label")
        sample = toxicity.labelled_sample(rows, 600).collect()
        assert 450 < len(sample) < 750 and 120 < sum(r.text == hot for r in sample) < 280
