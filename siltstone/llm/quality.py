"""Quality rules as a learned decision list over text statistics, in column expressions throughout.

Statistics of whole texts are built-in functions. The list is learned by sequential covering: a rule
grows by the condition ``statistic > or <= threshold`` with the best information gain on two thirds of
the labelled rows, is pruned from its end on the other third, and is kept if it is precise there; the
rows it covers are set aside and the next rule is grown. Every step is one aggregation over the labelled
statistics, whose result has one row per statistic and threshold. The finished list is an ordered
``CASE`` expression that anyone can read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT_WORDS = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_share",
    "mark_share", "stop_share", "line_words",
]


def split_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, width: int = REPEAT_WORDS) -> Column:
    """Number of words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by 64-bit hashes. Their positions are sorted by hash, so equal windows are
    neighbours; covered words are then counted from the gaps between repeated windows.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(ordered: Column) -> Column:
        same = lambda w, k: (F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"])
        twice = F.filter(ordered, lambda w, k: F.coalesce(same(w, k), F.get(ordered, k + 1)["h"] == w["h"], F.get(ordered, k - 1)["h"] == w["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda w: w["i"])), covered)

    def over(hashes: Column) -> Column:
        sorted_hashes = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(sorted_hashes, repeats))

    def windows(keys: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(keys) - (width - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(keys, i, width))), over)

    found = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) < width, F.lit(0)).otherwise(found).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id``, the base counts and the ratios rules may use, per row; a null text counts as an empty one.

    A narrow step over whole texts; ratios of texts without words are 0. The ``carry`` columns come along in
    a struct ``doc`` (null if there are none), where their names cannot clash.
    """
    doc = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), doc.alias("doc"))
    rows = rows.withColumn("words", split_words(F.col("text")))
    solid = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = rows.withColumn("lines", solid)
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    counts = rows.select(
        "id",
        "doc",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(lines).alias("n_lines"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        count_chars(text, CAPITALS).alias("n_capitals"),
        count_chars(text, MARKS).alias("n_marks"),
        count_chars(text, ".").alias("n_stops"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return counts.select(
        "id", "doc", *BASE,
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_capitals", "word_chars").alias("capital_share"),
        share("n_marks", "word_chars").alias("mark_share"), share("n_stops", "n_words").alias("stop_share"),
        share("n_words", "n_lines").alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    met = F.lit(True)
    for condition in rule:
        met = met & condition.column()
    return met


def first_rule(rules: list[Rule]) -> Column:
    """The text of the first rule that a row meets, null if it meets none: the list as one expression."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(matches(rule), F.lit(" and ".join(map(str, rule)))).otherwise(found)
    return found


def learn(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample_rows: int = 200_000,
    max_rules: int = 12,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_rows: int = 3,
) -> list[Rule]:
    """Rules for rows to reject (label 0), in order.

    ``stats`` comes from `statistics`. About ``sample_rows`` labelled rows are used (a documented bound),
    chosen by a hash of their id. Null labels and labels other than 0 and 1 are left out. A rule is kept
    if at least ``min_precision`` of the rows it covers in the pruning third, and at least ``min_rows``
    of them, are to be rejected; with too few labels the list is empty and nothing is rejected.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("bad"))
    share = min(1.0, sample_rows / max(marked.count(), 1))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(1 << 20))
    marked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stats.join(marked, "id").withColumn("grow", fold % 3 != 0)
    rows = materialise(rows.coalesce(8), "labelled")  # bounded by sample_rows, read once per step
    cuts = _thresholds(rows)
    if not cuts:
        return []
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        rule = _prune(left.filter(~F.col("grow")), _grow(left.filter("grow"), cuts, max_conditions), min_precision, min_rows)
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~matches(rule))
    return rules


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of every statistic among rows of either label."""
    probabilities = [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, *[i / 20 for i in range(2, 19)], 0.95, 0.98, 0.99, 0.995, 0.998, 1.0]
    found: dict[str, set[float]] = {f: set() for f in FEATURES}
    for bad in (True, False):
        quantiles = rows.filter(F.col("bad") == bad).approxQuantile(FEATURES, probabilities, 0.001)
        for feature, values in zip(FEATURES, quantiles):
            found[feature].update(values)
    return {f: sorted(v) for f, v in found.items()} if any(found.values()) else {}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of a condition that keeps p of p0 wanted and n of n0 unwanted rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions:
        bins = [F.struct(F.lit(f).alias("feature"), _bin(f, cuts[f]).alias("bin")) for f in FEATURES]
        kept = rows.filter(matches(rule)).select("bad", F.inline(F.array(*bins)))
        counted = kept.groupBy("feature", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        by = {(r.feature, r.bin): (r.p, r.n) for r in counted}
        best, best_gain = None, 1e-9
        for feature in FEATURES:
            parts = [by.get((feature, i), (0, 0)) for i in range(len(cuts[feature]) + 1)]
            p0, n0 = sum(p for p, _ in parts), sum(n for _, n in parts)
            if not p0 or not n0:
                return rule
            p = n = 0
            for (dp, dn), threshold in zip(parts, cuts[feature]):
                p, n = p + dp, n + dn
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = _gain(a, b, p0, n0)
                    if gain > best_gain:
                        best, best_gain = Condition(feature, above, threshold), gain
        if best is None:
            return rule
        rule = (*rule, best)
    return rule


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many thresholds lie below the value, so that bin i ends at threshold i inclusive."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(feature)))


def _prune(rows: DataFrame, rule: Rule, min_precision: float, min_rows: int) -> Rule:
    """The beginning of the rule that does best on unseen rows; nothing if that is not precise enough."""
    if not rule:
        return ()
    counts = []
    for size in range(1, len(rule) + 1):
        met = matches(rule[:size])
        counts += [F.count_if(met & F.col("bad")), F.count_if(met & ~F.col("bad"))]
    found = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    worth = [((p - n) / max(p + n, 1), p, n) for p, n in zip(found[::2], found[1::2])]
    size = max(range(len(rule)), key=lambda i: (worth[i][0], -i))
    _, p, n = worth[size]
    return rule[: size + 1] if p >= min_rows and p >= min_precision * (p + n) else ()


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (the first one met, else null) and ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", first_rule(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", **limits
) -> DataFrame:
    """``(id, base counts, base_failed, rule, kept)`` per row of ``docs``, with rules learned from ``labels``.

    Rows are judged one by one: repeated rows and null ids keep theirs, an empty table gives an empty result.
    """
    stats = materialise(statistics(docs, id_col, text_col).drop("doc"), "statistics")
    rules = learn(stats, labels, label_id, label_col, **limits)
    return judge(stats, rules).select("id", *BASE, "base_failed", "rule", "kept")
