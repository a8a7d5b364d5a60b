"""Phrases against plain counting: split words, cuts between blocks, odd rows."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import collocations


def plain(rows, least):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = []
    for (lang, words), a in counts.items():
        if len(words) == 1 or a < least:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((10**6 * a * a // (x * y), i, x, y) for i, (x, y) in enumerate(cuts))
        longer = [n for (other, w), n in counts.items() if other == lang and len(w) == 3 and len(words) == 2 and words in (w[:2], w[1:]) and n >= least]
        if not any(100 * n >= 50 * a for n in longer):
            found.append((lang, -score, -a, " ".join(words).encode(), l, r, totals[lang]))
    return sorted(found)


def got(df):
    rows = sorted(df.collect(), key=lambda r: (r.lang, r["rank"]))
    ranks = collections.defaultdict(list)
    for r in rows:
        ranks[r.lang].append(r["rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())
    return [(r.lang, -r.score, -r.a, r.phrase.encode(), r.l, r.r, r.n) for r in rows]


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 300)])
def test_against_plain_counting(spark, seed, block):
    draw = np.random.default_rng(seed)
    words = np.array(["the", "The", "of", "été", "x\x01", "x", "a", "b", "c", "d", "z9", "中", "-", " q"])
    odds = np.array([30, 3, 8, 2, 2, 2, 3, 3, 3, 3, 1, 1, 1, 1]) / 63
    ends = np.array([" ", "  ", "\t", ". ", ",", "\n", " ! ", "\r"])
    rows = []
    for i in range(120):
        text = "".join(w + e for w, e in zip(draw.choice(words, 60, p=odds), draw.choice(ends, 60, p=[0.6, 0.1, 0.1, 0.04, 0.04, 0.04, 0.04, 0.04])))
        rows.append((str(draw.choice(["en", "fr"])) if i % 10 else None, text))
    rows += [("en", None), ("en", ""), (None, ""), ("de", " . ,"), ("es", "too rare to count"), rows[0], rows[0], ("und", "the of the of " * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("word", "n", "id", "block", "phrase", "rank")])
    want = plain(rows, 5)
    assert want and got(collocations.collocations(docs, least=5, top=None, block=block)) == want
    first = [r for lang in sorted({w[0] for w in want}) for r in [w for w in want if w[0] == lang][:7]]
    assert got(collocations.collocations(docs, least=5, top=7, block=block)) == first
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_products_beyond_64_bits():
    a = 3 * 10**12
    assert collocations.weakest_cut(a, [(a, 4 * 10**12), (a + 1, 4 * 10**12)]) == (10**6 * a * a // ((a + 1) * 4 * 10**12), a + 1, 4 * 10**12)
    assert collocations.weakest_cut(10, [(20, 10), (10, 20)]) == (500_000, 20, 10)


def test_very_long_text(spark):
    docs = spark.createDataFrame([("en", "one two three four. " * 200_000)], "lang string, text string")
    rows = collocations.collocations(docs).collect()
    assert {(r.phrase, r.a) for r in rows} == {("one two three", 200_000), ("two three four", 200_000)} and {r.n for r in rows} == {800_000}
