"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's score is a logistic function of its words; a document's is the noisy-or of its sentences,
1 - prod(1 - s). Training follows the gradient of the document labels through the noisy-or, so weight
gathers on the sentences that explain a label; the same scores then locate offending sentences.
Every distinct word of a sentence adds the weights of itself and of its first four and five letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import id_type, map_rows, texts

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
KNOWN_WORDS = 1 << 18


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence: up to full stops, exclamation or question marks, or a line end."""
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class Model:
    """A weight per feature and a bias; an untrained model scores everything as the bias says."""

    weights: dict[str, float]
    bias: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentence_scores(self, text: str | None, known: dict[str, float]) -> list[float]:
        """The score of every sentence, in order; ``known`` remembers weights of words."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a few letters grow in lower case; keep positions
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        logits = []
        for start, end in sentences(low):
            logit = self.bias
            for word in set(_TOKEN.findall(low, start, end)):
                weight = known.get(word)
                if weight is None:
                    weight = known[word] = self.word_weight(word)
                logit += weight
            logits.append(logit)
        if len(known) > KNOWN_WORDS:
            known.clear()
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist() if logits else []


def noisy_or(scores: list[float]) -> float:
    """Probability that at least one sentence offends; 0 without sentences."""
    return float(-np.expm1(np.sum(np.log1p(-np.minimum(scores, 1 - 1e-12))))) if scores else 0.0


def labelled_sample(rows: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` of the rows ``id, text, label``, by a hash of id and text: equal texts are chosen one by one."""
    share = int(min(1.0, sample_rows / max(rows.select("label").count(), 1)) * (1 << 20))
    return rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share).drop("id")


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 20_000,
    max_words: int = 4_096,
    rounds: int = 300,
) -> Model:
    """Fit on about ``sample_rows`` labelled rows (a documented bound), chosen by a hash of id and text.

    Spark counts in how many positive and negative documents each feature stands and keeps up to
    ``max_words`` features by the weight of evidence (two documents prove nothing). Documents
    then shrink to their sentences' kept words, which is all that training on the driver sees. Null
    texts, null labels and labels other than 0 and 1 are left out; with no positive or no negative rows
    the model is empty and scores nothing as toxic.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter("text is not null and label in (0, 1)")
    sample = materialise(labelled_sample(rows, sample_rows), "toxic-sample")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, -30.0)
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter("found", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    words = sample.select("label", found.alias("found"))
    words = words.select("label", F.explode(F.array_distinct(F.concat("found", *stems))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).filter("pos + neg >= 3")
    pos_rate, neg_rate = (F.col("pos") + 0.5) / (sizes[1] + 1), (F.col("neg") + 0.5) / (sizes[0] + 1)
    evidence = F.abs(F.log(pos_rate / neg_rate)) * F.sqrt(F.col("pos") + F.col("neg"))
    kept = counts.orderBy(evidence.desc(), "word").limit(max_words)
    vocabulary = {r.word: i for i, r in enumerate(kept.select("word").collect())}

    def run(batches: Iterable[tuple]) -> Iterator[tuple]:
        for label, text in batches:
            low = text.lower()
            bags = []
            for start, end in sentences(low):
                words = set(_TOKEN.findall(low, start, end))
                bags.append([vocabulary[f] for w in words for f in features(w) if f in vocabulary])
            sizes, flat = [len(b) for b in bags], [i for b in bags for i in b]
            yield label, np.array(sizes, "<i4").tobytes(), np.array(flat, "<i4").tobytes()

    bags = map_rows(sample.select("label", "text"), run, "label int, sizes binary, words binary").collect()
    sizes, words = ([np.frombuffer(r[name], "<i4") for r in bags] for name in ("sizes", "words"))
    weights, bias = _fit(np.array([r.label for r in bags], float), sizes, words, len(vocabulary), rounds)
    return Model({w: float(weights[i]) for w, i in vocabulary.items() if abs(weights[i]) > 1e-3}, float(bias))


def _fit(labels: np.ndarray, sizes: list, words: list, n_words: int, rounds: int) -> tuple[np.ndarray, float]:
    """Adagrad on the mean log loss of the noisy-or, with a small pull of the weights to zero."""
    per_doc = np.array([len(s) for s in sizes])
    doc_of = np.repeat(np.arange(len(labels)), per_doc)
    sentence_of = np.repeat(np.arange(len(doc_of)), np.concatenate(sizes))
    word = np.concatenate(words)
    weights, bias = np.zeros(n_words), -4.0
    square, square_bias = np.full(n_words, 1e-8), 1e-8
    balance = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)) / len(labels)
    for _ in range(rounds):
        logits = bias + np.bincount(sentence_of, weights=weights[word], minlength=len(doc_of))
        score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        none = np.bincount(doc_of, weights=np.log1p(-np.minimum(score, 1 - 1e-12)), minlength=len(labels))
        some = np.maximum(-np.expm1(none), 1e-9)
        # d loss / d logit of a sentence: s for label 0, -s * prod(1 - s) / (1 - prod(1 - s)) for label 1
        slope = balance * np.where(labels > 0, -np.exp(none) / some, 1.0)
        push = slope[doc_of] * score
        step = np.bincount(word, weights=push[sentence_of], minlength=n_words) + 1e-5 * weights
        step_bias = push.sum()
        square += step**2
        square_bias += step_bias**2
        weights -= 0.5 * step / np.sqrt(square)
        bias -= 0.3 * step_bias / np.sqrt(square_bias)
    return weights, bias


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, worst, worst_score, offending)`` per row of ``docs``.

    ``score`` is the noisy-or over all sentences of the whole text, ``worst`` the text of the sentence
    with the highest score (null without sentences), ``offending`` the spans ``(start, end, score)`` of
    sentences at 0.5 or more. Null, empty and blank texts score 0. Rows are judged one by one.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        known: dict[str, float] = {}
        for key, text in rows:
            scores = model.sentence_scores(text, known)
            if not scores:
                yield key, 0.0, None, None, []
                continue
            spans = sentences(text)
            top = int(np.argmax(scores))
            bad = [{"start": a, "end": b, "score": s} for (a, b), s in zip(spans, scores) if s >= 0.5]
            yield key, noisy_or(scores), text[slice(*spans[top])].strip(), scores[top], bad

    schema = f"id {id_type(docs, id_col)}, score double, worst string, worst_score double, offending array<struct<start:int,end:int,score:double>>"
    return map_rows(texts(docs, id_col, text_col), run, schema)
