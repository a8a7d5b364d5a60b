"""Near-duplicates of the pipeline against the Jaccard similarity of all pairs."""

import collections
import contextlib
import itertools

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
from siltstone.llm import simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(texts):
    """The smallest id of every id's group, by comparing all pairs of sets."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in sets}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], SCHEMA).repartition(5)


def found(spark, texts):
    return {r.id: r.component_id for r in simhash_dedup.similar_documents(frame(spark, texts)).collect()}


def test_twins_in_a_crowd(spark):
    """Every text is 60 % one template, and has one twin of similarity about 0.82."""
    draw = np.random.default_rng(11)
    template, texts = [f"t{i}" for i in range(180)], {}
    for key in range(0, 400, 2):
        own = [f"o{key}x{i}" for i in range(120)]
        texts[key] = " ".join(template + own)
        own[100:] = [f"n{key}x{i}" for i in range(len(own[100:]) + int(draw.integers(0, 6)))]
        texts[key + 1] = " ".join(template + own)
    want = groups(texts)
    assert collections.Counter(want.values()) == {k: 2 for k in range(0, 400, 2)}
    assert found(spark, texts) == want


def test_links_at_the_threshold(spark):
    """Pairs of 100 common shingles: 0.8 with 25 others links, 0.794 with 26 does not."""
    texts = {}
    for number in range(120):
        base = [f"b{number}x{i}" for i in range(104)]
        texts[2 * number] = " ".join(base)
        texts[2 * number + 1] = " ".join(base + [f"e{number}x{i}" for i in range(25 + number % 2)])
    assert found(spark, texts) == {k: k - k % 2 if k % 4 < 2 else k for k in texts}


def test_stage_leaves_nothing_and_removes_nothing_clean(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    want = {k for k, v in groups(texts).items() if k == v}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == want


def test_many_near_copies_make_few_pairs(spark):
    """Each differs from each other by two words; groups and near copies of a different length stay apart."""
    words = [f"w{i}" for i in range(150)]
    texts = {k: " ".join(w if i != k % 140 else f"x{k}" for i, w in enumerate(words)) for k in range(300)}
    texts |= {1000: " ".join(words[:100]), 1001: " ".join(words[:130])}
    assert found(spark, texts) == groups(texts)


def test_near_fingerprints_are_compared(spark, monkeypatch):
    """The first links come from the SimHash grid join; the exact comparison decides them."""
    asked = []
    links = simhash_dedup.links
    monkeypatch.setattr(simhash_dedup, "links", lambda distinct, radius=3: asked.append(radius) or links(distinct, radius))
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"]), 3: " ".join(words[::-1]), 4: "", 5: " "}
    assert found(spark, texts) == groups(texts) | {5: 4} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert asked == [3]


def test_changed_copies_that_do_not_link_make_no_pairs(spark, monkeypatch):
    """Texts with a few more changes of one template than the threshold allows meet in no row of the join."""
    written, materialise = {}, simhash_dedup.materialise
    monkeypatch.setattr(simhash_dedup, "SAMPLE", 1)
    monkeypatch.setattr(simhash_dedup, "materialise", lambda df, name="step", *rest: written.setdefault(name, materialise(df, name, *rest)))
    monkeypatch.setattr(simhash_dedup, "scratch", lambda: contextlib.nullcontext(Kept()))
    words = [f"w{i}" for i in range(150)]
    texts = {k: " ".join(f"x{k}y{i}" if i in (20 + k % 7, 60 + k % 11, 100 + k % 5, 130 + k % 3) else w for i, w in enumerate(words)) for k in range(60)}
    assert found(spark, texts) == groups(texts) == {k: k for k in texts}
    assert written["posts"].count() > 0 and written["met"].count() == 0


class Kept:
    def keep(self, df, name="result"):
        return df

    def drop(self, *dfs):
        pass
