"""One query per operator with its fixed result columns, and the corpus pipeline's registration."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import table
from . import byte_bpe, collocations, fingerprints, language, packing, quality, sharding, simhash_dedup, substring_dedup, suffix_dedup, toxicity, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups by 3-word SimHash within 3 bits."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), ranks).withColumnRenamed("id", "doc_id")


#: Host, path and verdict of the rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL's rule, else its host's verdict from trust and distrust over links."""
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of a learned decision list for every document."""
    found = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside one of five folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    learn = labels.filter(~held_out & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(learn, "doc_id"), sample_rows=20_000)
    scored = toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts, equal texts together where they fit."""
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40).withColumnRenamed("id", "doc_id")
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4,096 tokens."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, capacity=4096, end_id=1).withColumnRenamed("id", "doc_id")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated 35-word passages are gone."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language.train(docs.filter(~held_out), sample_rows=20_000)
    found = language.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    found = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    show = lambda name: F.lower(F.hex(name)).alias(name)
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        show("fingerprint"), show("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words per language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all whole, finite vectors: four parts, 256 entries, four rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4).withColumnRenamed("id", "vec_id")


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document once repeated 400-byte strings are gone."""
    found = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), window=400)
    left = F.coalesce(F.length("kept").cast("long"), F.col("n_bytes"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - left).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"),
    )


SQL["op8_substring_dedup"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT r, doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
starts AS (
    SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
    FROM lists, LATERAL (SELECT unnest(generate_series(1, len(words) - 34)) AS i)
),
twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS k FROM starts SEMI JOIN twice USING (h)),
singles AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM lists),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM singles ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM lists LEFT JOIN kept USING (r)
"""

SQL["op11_collocations"] = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
    FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
),
places AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i + k - 1] AS words FROM places, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(words)),
counts AS MATERIALIZED (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
parts AS MATERIALIZED (
    SELECT lang, phrase, k, a, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS rest
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM counts WHERE k > 1)
),
cuts AS (
    SELECT p.lang, p.phrase, p.k, p.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * p.a * p.a) // (x.a::HUGEINT * y.a) AS score
    FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.head JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
    SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a AS b FROM counts WHERE k = 3
),
covered AS (SELECT DISTINCT lang, phrase FROM lowest JOIN longer USING (lang, phrase) WHERE k = 2 AND 100 * b >= 50 * a),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score::BIGINT AS score
    FROM lowest ANTI JOIN covered USING (lang, phrase)
) JOIN totals USING (lang)
WHERE rank <= 2000
"""
SQL["op13_suffix_dedup"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT r, s, md5(substr(h, (2 * s + 1)::INT, 800)) AS m
    FROM texts, LATERAL (SELECT unnest(generate_series(0, len(h) // 2 - 400)) AS s)
),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM windows SEMI JOIN twice USING (m)),
numbered AS (SELECT r, s, count(*) FILTER (WHERE before IS NULL OR before + 400 < s) OVER (PARTITION BY r ORDER BY s) AS k FROM starts),
runs AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY r, k),
gaps AS (
    SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
    UNION ALL
    SELECT r, coalesce(max(b), 0), any_value(len(h) // 2) FROM texts LEFT JOIN runs USING (r) GROUP BY r
),
kept AS (SELECT r, string_agg(substr(h, (2 * gaps.a + 1)::INT, (2 * (gaps.b - gaps.a))::INT), '' ORDER BY gaps.a) AS h FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, len(texts.h) // 2 AS n_bytes, (len(texts.h) - len(kept.h)) // 2 AS n_removed,
       (SELECT count(*) FROM runs WHERE runs.r = texts.r) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM texts JOIN kept USING (r)
"""


def _url_sql(rounds: int) -> str:
    """The URL query in SQL: rules by string comparison, and one pair of steps per round of both walks."""
    entries = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    steps = []
    damp, rest = url_filter.DAMPING, 1 - url_filter.DAMPING
    for i in range(rounds):
        steps.append(f"""
r{i + 1} AS MATERIALIZED (
    SELECT h.host, {rest} * trusted + {damp} * coalesce(f.t, 0) AS t, {rest} * base + {damp} * coalesce(f.tb, 0) AS tb,
           {rest} * blocked + {damp} * coalesce(b.d, 0) AS d, {rest} * base + {damp} * coalesce(b.db, 0) AS db
    FROM seeds h
    LEFT JOIN (SELECT target AS host, sum(a * t) AS t, sum(a * tb) AS tb FROM shares JOIN r{i} ON source = r{i}.host GROUP BY target) f USING (host)
    LEFT JOIN (SELECT source AS host, sum(z * d) AS d, sum(z * db) AS db FROM shares JOIN r{i} ON target = r{i}.host GROUP BY source) b USING (host)
)""")
    letters = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = letters.format("coalesce(regexp_extract({}, '://([^/?#]*)', 1), '')")
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {entries}),
whole AS (
    SELECT row_number() OVER () AS r, page_id, {host.format("url")} AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html
    FROM pages
),
best AS (
    SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS ruled
    FROM whole JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY r
),
ruled AS (SELECT page_id, host, path, rule, ruled FROM whole LEFT JOIN best USING (r)),
links AS (
    SELECT host AS source, unnest(regexp_extract_all(coalesce(html, ''), '{url_filter.LINK.replace("'", "''")}', 1)) AS link FROM whole
),
path_links AS (
    SELECT host, path, count(*) AS n
    FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{url_filter.PATH.replace("'", "''")}', 1)) AS path FROM whole WHERE host <> '')
    GROUP BY ALL
),
shared AS (SELECT host, path, n / count(*) OVER (PARTITION BY path) AS w, count(*) OVER (PARTITION BY path) AS hosts FROM path_links),
edges AS (
    SELECT host AS source, path AS target, w FROM shared WHERE hosts > 1
    UNION ALL SELECT path, host, w FROM shared WHERE hosts > 1
    UNION ALL SELECT source, target, count(*) AS w
    FROM (SELECT source, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS target FROM links)
    WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
),
shares AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS a, w / sum(w) OVER (PARTITION BY target) AS z FROM edges),
own AS (
    SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked
    FROM ruled GROUP BY host
),
seeds AS (
    SELECT host, CASE WHEN starts_with(host, '/') THEN 0.0 ELSE 1.0 END AS base, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked
    FROM (SELECT source AS host FROM edges UNION SELECT target FROM edges UNION SELECT host FROM own) LEFT JOIN own USING (host)
),
r0 AS (SELECT host, {rest} * trusted AS t, {rest} * base AS tb, {rest} * blocked AS d, {rest} * base AS db FROM seeds),{",".join(steps)}
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN d / db >= {url_filter.BLOCK_SHARE} AND d / db > t / tb THEN 'block' ELSE 'allow' END) AS verdict,
       round(t / tb, 6) AS trust, round(d / db, 6) AS distrust
FROM ruled JOIN r{rounds} USING (host)
"""


#: The loop ends by a tolerance; after 40 rounds at a damping of a half nothing moves in the twelfth digit.
SQL["op3_url_filters"] = _url_sql(40)
