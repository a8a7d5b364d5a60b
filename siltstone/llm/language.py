"""Language labels by Viterbi over words.

Counts of character trigrams per language, learned from labelled documents, give every word a score per
language. The scripts of a word's letters narrow its candidates to languages seen with such letters.
A Viterbi path over the words, with a penalty for each switch, then labels spans of mixed text. Texts of
a batch advance together, word by word, so the path costs a few array operations per word position.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_rows, texts

BUCKETS = 1 << 15
UNKNOWN = "und"
#: First code points of script ranges and the script each starts; ranges without letters do not matter.
SCRIPT_STARTS = {
    0x0000: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew", 0x0600: "arabic",
    0x0900: "devanagari", 0x0980: "indic", 0x0E00: "thai", 0x0E80: "other", 0x10A0: "georgian", 0x1100: "hangul",
    0x1200: "ethiopic", 0x1300: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "other", 0x2C60: "latin",
    0x2C80: "other", 0x3040: "kana", 0x3100: "other", 0x3130: "hangul", 0x3190: "other", 0x31F0: "kana", 0x3200: "other",
    0x3400: "han", 0xA000: "other", 0xA720: "latin", 0xA800: "other", 0xAC00: "hangul", 0xD800: "other", 0xF900: "han",
    0xFB00: "latin", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFE00: "other", 0xFE70: "arabic", 0xFF00: "latin",
    0xFF66: "kana", 0xFFA0: "hangul", 0xFFE0: "other", 0x20000: "han", 0x33480: "other",
}
SCRIPTS = sorted(set(SCRIPT_STARTS.values()))
_STARTS = np.array(sorted(SCRIPT_STARTS))
_SCRIPT_AT = np.array([SCRIPTS.index(SCRIPT_STARTS[s]) for s in sorted(SCRIPT_STARTS)])
BATCH_CHARS = 1 << 21


class Letters:
    """Lower case, letter flags, mark flags and scripts of all code points, built once per process."""

    _made: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if cls._made is None:
            points = np.arange(0x110000, dtype=np.uint32)
            lower, letter, mark = points.copy(), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
            for point in range(0x110000):
                char = chr(point)
                kind = unicodedata.category(char)[0]
                mark[point] = kind == "M"
                if kind == "L":
                    letter[point] = True
                    low = char.lower()
                    lower[point] = ord(low) if len(low) == 1 else point
            script = _SCRIPT_AT[np.searchsorted(_STARTS, points, side="right") - 1].astype(np.int8)
            cls._made = lower, letter, mark, script
        return cls._made


def split_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, word of each bucket, script per word, letters per word)`` of a text's words.

    A word is a run of letters, each with the combining marks after it. Its trigrams include a boundary before and after it.
    """
    lower, letter, mark, script = Letters.tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    marks = mark[points]
    base = np.maximum.accumulate(np.where(marks, 0, np.arange(len(points)))) if len(points) else np.zeros(0, np.int64)
    inside[1:-1] = letter[points] | (marks & letter[points[base]])
    chars = np.zeros(len(points) + 2, np.uint64)
    chars[1:-1] = np.where(inside[1:-1], lower[points], 0)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        code = (chars[at - 1] * np.uint64(0x110000) + chars[at]) * np.uint64(0x110000) + chars[at + 1]
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    buckets = (code >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    word = np.searchsorted(starts, at, side="right") - 1
    return buckets, word, script[points[starts - 1]], np.bincount(word, minlength=len(starts))


class Model:
    """Log-probabilities of trigram buckets per language, and the scripts each language uses."""

    def __init__(self, languages: list[str], scores: np.ndarray, scripts: np.ndarray, switch: float):
        self.languages, self.scores, self.scripts, self.switch = languages, scores, scripts, switch

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A score per word and language, the letters of each word, and whether a learned language uses its script.

        If no language was learned, every word counts as known.
        """
        buckets, word, script, letters = split_words(text)
        if not len(letters) or not self.languages:
            return np.empty((len(letters), len(self.languages)), np.float32), letters, np.ones(len(letters), bool)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        scores = np.add.reduceat(self.scores[buckets], first, axis=0)
        allowed = self.scripts[script]
        known = allowed.any(axis=1)
        return np.where(allowed | ~known[:, None], scores, scores - 1e4), letters, known

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best sequence of languages for each text, all texts advancing together."""
        if not self.languages:
            return [np.empty(0, np.int16)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lengths = np.array([len(scores[i]) for i in order])
        flat = np.concatenate([scores[i] for i in order]) if order else np.empty((0, len(self.languages)))
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if order else lengths
        longest = int(lengths[0]) if order else 0
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        total = np.zeros((len(order), len(self.languages)))
        back: list[np.ndarray] = []
        for t in range(longest):
            n = active[t]
            known = total[:n]
            best = known.argmax(axis=1)
            other = known[np.arange(n), best][:, None] - self.switch
            stays = known >= other
            back.append(np.where(stays, -1, best[:, None]).astype(np.int16))
            total[:n] = np.where(stays, known, other) + flat[offsets[:n] + t]
        state = total.argmax(axis=1)
        found = np.empty(len(flat), np.int16)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            found[offsets[:n] + t] = state[:n]
            came = back[t][np.arange(n), state[:n]]
            state[:n] = np.where(came >= 0, came, state[:n])
        result: list[np.ndarray] = [np.empty(0, np.int16)] * len(order)
        for rank, i in enumerate(order):
            result[i] = found[offsets[rank] : offsets[rank] + lengths[rank]]
        return result


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000, switch: float = 12.0
) -> Model:
    """Trigram statistics of about ``sample_rows`` labelled rows (a documented bound; null texts and labels do not count).

    Rows are chosen by a hash of the text, so every language keeps its share. Tasks add up their own
    counts; what reaches the driver is one row per language and bucket, whatever the input.
    ``switch`` is the log-score a change of language costs. Without labelled rows the model is empty.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    total = rows.select("lang").count()
    kept = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 20)))

    def run(batches: Iterable[tuple]) -> Iterator[tuple]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for text, lang in batches:
            buckets, word, script, letters = split_words(text)
            grams[lang] = grams.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(buckets, minlength=BUCKETS)
            scripts[lang] = scripts.get(lang, np.zeros(len(SCRIPTS))) + np.bincount(script, weights=letters, minlength=len(SCRIPTS))
        for kind, counts in (("gram", grams), ("script", scripts)):
            for lang, values in counts.items():
                for key in np.flatnonzero(values).tolist():
                    yield lang, kind, key, int(values[key])

    counted = map_rows(kept.select("text", "lang"), run, "lang string, kind string, key int, n long")
    counts = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts.lang.unique())
    number = counts.lang.map({lang: i for i, lang in enumerate(languages)})
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for table, kind in ((grams, "gram"), (scripts, "script")):
        part = counts[counts.kind == kind]
        table[part.key.to_numpy(int), number[part.index].to_numpy(int)] = part.n.to_numpy(float)
    smooth = 0.5
    logs = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * BUCKETS)) if languages else grams
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logs.astype(np.float32), share > 0.001, switch)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, spans)`` per row of ``docs``.

    ``spans`` lists maximal runs of words of one language as ``(first word, words, lang)``. ``lang_pred``
    has the most letters (ties: first in the alphabet), ``score`` is its share of letters. Null texts, texts without a letter, and
    all texts under an empty model are ``und`` with score 0 and no spans. Rows are judged one by one, so
    repeated rows and null ids keep theirs.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for batch in _batches(rows):
            scored = [model.word_scores(text or "") for _, text in batch]
            for (key, _), (_, letters, _), path in zip(batch, scored, model.paths([s for s, *_ in scored])):
                yield key, *_verdict(model, letters, path)

    schema = f"id {id_type(docs, id_col)}, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"
    return map_rows(texts(docs, id_col, text_col), run, schema)


def predicted(model: Model):
    """A column function of a text: a struct of ``lang_pred`` and ``score`` as in `identify`, and ``known``.

    ``known`` is the share of letters in words of a script that a learned language uses; 0 without letters.
    """

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for batch in _batches((None, text) for text in texts):
            scored = [model.word_scores(text or "") for _, text in batch]
            for (_, letters, known), path in zip(scored, model.paths([s for s, *_ in scored])):
                rows.append((*_verdict(model, letters, path)[:2], float(letters[known].sum() / max(letters.sum(), 1))))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "known"])

    return predict


def _verdict(model: Model, letters: np.ndarray, path: np.ndarray) -> tuple[str, float, list[dict]]:
    if not len(path) or not model.languages:
        return UNKNOWN, 0.0, []
    share = np.bincount(path, weights=letters, minlength=len(model.languages)) / letters.sum()
    starts = np.flatnonzero(np.diff(path, prepend=-1))
    sizes = np.diff(starts, append=len(path))
    spans = [{"first": int(a), "words": int(n), "lang": model.languages[path[a]]} for a, n in zip(starts, sizes)]
    best = int(share.argmax())
    return model.languages[best], float(share[best]), spans


def _batches(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += len(row[1] or "")
        if held > BATCH_CHARS:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch
