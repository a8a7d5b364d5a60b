"""Repeated byte strings against a brute-force version: short windows, periodic texts, many copies, cuts between blocks."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import suffix_dedup


def brute(texts, window):
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        yield bytes(np.frombuffer(t, np.uint8)[~gone]), [tuple(e) for e in edges.reshape(-1, 2).tolist()]


def odd_texts(seed):
    draw = np.random.default_rng(seed)
    pieces = ["".join(draw.choice(list("abc é\n"), draw.integers(5, 90))) for _ in range(12)]
    texts = ["".join(draw.choice(pieces, draw.integers(0, 7))) for _ in range(60)]
    texts += ["a" * 70, "ab" * 50, "ba" * 40, "", None, texts[0], texts[0], "x" * 19, pieces[0] * 3, pieces[1] + "z" + pieces[1]]
    texts += ["".join(draw.choice(list("abcdefgh"), 300))]
    return texts + [texts[-1][:200] + "!" + texts[-1][200:], texts[-1][50:120]]


@pytest.mark.parametrize("window", [3, 20, 60])
def test_against_brute_force(spark, window):
    texts = odd_texts(window)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("id", "k1", "n", "data", "spans", "kept")])
    got = {r.id: r for r in suffix_dedup.remove_repeated_bytes(docs.repartition(3), window).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (kept, gone) in enumerate(brute(data, window)):
        row = got[i]
        assert row.n_bytes == len(data[i])
        assert ([] if row.spans is None else [tuple(s) for s in row.spans]) == gone, (i, texts[i])
        assert (data[i] if row.kept is None else bytes(row.kept)) == kept
    assert suffix_dedup.remove_repeated_bytes(docs.limit(0), window).collect() == []


def test_anchors_of_equal_windows_agree():
    draw = np.random.default_rng(5)
    data = bytes(draw.integers(97, 100, 5000, dtype=np.uint8))
    for window, block in ((60, 1 << 20), (60, 37), (400, 512)):
        width = suffix_dedup.widths(window)[0]
        chosen = {}
        for at, low, high in suffix_dedup.anchors(data, window, width, block):
            for start in range(at - high, at - low + 1):
                assert start not in chosen
                chosen[start] = at - start
        assert set(chosen) == set(range(len(data) - window + 1))
        by_text = collections.defaultdict(set)
        for start, far in chosen.items():
            by_text[data[start : start + window]].add(far)
        assert all(len(v) == 1 for v in by_text.values())


def test_one_text_in_a_third_of_the_rows(spark):
    hot = "".join(chr(97 + i * i % 23) for i in range(450))
    rows = spark.range(900).selectExpr("id AS doc_id", f"if(id % 3 = 0, '{hot}', concat('{hot[:410]}', id, '-', id)) AS text")
    data = {r.doc_id: r.text.encode() for r in rows.collect()}
    got = {r.id: r for r in suffix_dedup.remove_repeated_bytes(rows, 400).collect()}
    assert {len(got[i].kept) for i in data if i % 3 == 0} == {0}
    assert [bytes(got[i].kept) for i in data] == [kept for kept, _ in brute(list(data.values()), 400)]
