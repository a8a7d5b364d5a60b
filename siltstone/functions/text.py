"""Text functions: cleaning, counting, tokenising, stemming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Words the corpus report leaves out of its rankings (callers add their product's name).
REPORT_STOPWORDS = (
    """a an the and or but if then than that this these those of in on at to for with from by as is are was
    were be been being it its it's you your we our us they their he she his her i me my what which who whom
    how when where why can could should would will shall may might must do does did done have has had not no
    yes so such about into over under more most less least other others new all any each few many much some
    own same very just now also there here get got make made use used using via per vs top best need needs
    way ways thing things one two three know knows help helps let lets don't doesn't isn't you're it’s –"""
).split()
# The stop words of Lucene's English analyzer.
ENGLISH_STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
    "they this to was will with"
).split()
# What the corpus report calls a word; what the search index calls a word.
REPORT_WORD = r"[a-z][a-z0-9'\-]{2,}"
INDEX_WORD = r"[\p{L}\p{N}]+"
ENGLISH_WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

# The reply when nothing was retrieved, and the part by which evaluation knows it.
NO_ANSWER_TEXT = "I couldn't find anything in the indexed corpus to answer that."
NO_ANSWER_MARKER = "couldn't find anything in the indexed corpus"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Whitespace-separated words, Unicode spaces included."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def estimated_tokens(word_total: Column) -> Column:
    """Words x 1.3, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(word_total * F.lit(1.3)).cast("int"))


def token_count(text: Column | str) -> Column:
    return estimated_tokens(word_count(text))


def squeeze(text: Column | str) -> Column:
    """Collapse runs of blanks and of empty lines."""
    one_space = F.regexp_replace(_col(text), "[ \t ]+", " ")
    return F.regexp_replace(F.regexp_replace(one_space, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def report_terms(text: Column | str, stopwords: list[str] = REPORT_STOPWORDS) -> Column:
    """Lower-cased report words without the report's stop words, in text order."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(REPORT_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stopwords))


def bigrams(terms: Column) -> Column:
    """Adjacent pairs of a term array."""
    n = F.greatest(F.size(terms) - 1, F.lit(0))
    return F.zip_with(
        F.slice(terms, F.lit(1), n), F.slice(terms, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def index_terms(text: Column | str) -> Column:
    """Lower-cased words without English stop words: the unstemmed search analyzer."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(INDEX_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(ENGLISH_STOPWORDS))


def bar(value: Column, peak: Column, width: int = 28) -> Column:
    """Text bar: at least one mark for a positive value, half-even rounding."""
    marks = F.greatest(F.lit(1), F.bround(value / peak * width).cast("int"))
    return F.when(value > 0, F.repeat(F.lit("#"), marks)).otherwise("")


# Porter's English stemmer (1980) as rewrite rules, so that Spark and SQL can run the same list. A step is a
# list of rules in order: the first whose ending fits decides, and rewrites if the stem meets its condition.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_HEAD = f"^(?:{_CONSONANTS})?"
_ANY, _SOME_VOWEL = "^[a-z]*", f"{_HEAD}[aeiouy][a-z]*"
_M1 = f"{_HEAD}{_VOWELS}{_CONSONANTS}[a-z]*"
_M2 = f"{_HEAD}(?:{_VOWELS}{_CONSONANTS}){{2}}[a-z]*"
_HALF = f"{_HEAD}{_VOWELS}{_CONSONANTS}{_VOWELS}[a-z]*"
_SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]"

# Endings and their replacements, longest first where one ends another.
_DERIVED = (
    "ational:ate ization:ize iveness:ive fulness:ful ousness:ous tional:tion biliti:ble entli:ent ousli:ous ation:ate "
    "alism:al aliti:al iviti:ive enci:ence anci:ance izer:ize abli:able alli:al ator:ate eli:e"
)
_ADJECTIVES = "icate:ic ative: alize:al iciti:ic ical:ic ness: ful:"
_DROPPED = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou"


def _endings(pairs: str, condition: str) -> list[tuple[str, str, str]]:
    return [(end, condition, new) for end, _, new in (p.partition(":") for p in pairs.split())]


#: Each rule: ending, condition on what stands before it, replacement. Endings are patterns.
STEM_STEPS: list[list[tuple[str, str, str]]] = [
    [("['’]s", "^.*", "")],
    [("sses", _ANY, "ss"), ("ies", _ANY, "i"), ("ss", _ANY, "ss"), ("s", _ANY, "")],
    [("eed", _M1, "ee"), ("ed", _SOME_VOWEL, "#"), ("ing", _SOME_VOWEL, "#")],
    [("at#", _ANY, "ate"), ("bl#", _ANY, "ble"), ("iz#", _ANY, "ize"),
     *[(f"{c}{c}#", _ANY, c) for c in "bcdfghjkmnpqrtvwx"], ("#", _SHORT, "e"), ("#", _ANY, "")],
    [("y", _SOME_VOWEL, "i")],
    _endings(_DERIVED, _M1),
    _endings(_ADJECTIVES, _M1),
    [("ion", f"{_HALF}[st]", ""), *[(end, _M2, "") for end in _DROPPED.split()]],
    [("e", _M2, ""), ("e", f"{_SHORT}", "e"), ("e", _M1, "")],
    [("l", f"{_HALF}l", "")],
]


def _stem_tests(ending: str, condition: str) -> tuple[str, str]:
    """Patterns of whole words: those for which a rule decides, and those it rewrites, stem captured.

    An ending that several rules share (``#``, ``e``) leaves words that fail its condition to the next.
    """
    rewritten = f"({condition}){ending}$"
    return rewritten if ending in ("#", "e") else f"^.*{ending}$", rewritten


def english_stem(term: Column | str) -> Column:
    """Stem of a lower-case term; a possessive goes first, short and non-English words stay."""
    word = F.regexp_replace(_col(term), "['’]s$", "")
    out = let(word, lambda w: _stem_steps(w, 1))
    return F.when(word.rlike("^[a-z]{3,}$"), out).otherwise(word)


def _stem_steps(word: Column, step: int) -> Column:
    if step == len(STEM_STEPS):
        return word
    return let(_stem_step(word, STEM_STEPS[step]), lambda w: _stem_steps(w, step + 1))


def _stem_step(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    out = word
    for ending, condition, new in reversed(rules):
        test, rewritten = _stem_tests(ending, condition)
        out = F.when(word.rlike(test), F.regexp_replace(word, rewritten, f"$1{new}")).otherwise(out)
    return out


def english_terms(text: Column | str) -> Column:
    """Lower-cased words, apostrophes inside kept, without English stop words: what `english_stem` stems."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(ENGLISH_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(ENGLISH_STOPWORDS))


def stem_sql(term: str) -> str:
    """The same stemmer as a DuckDB expression over a term expression, by nested sub-queries."""
    bare = f"regexp_replace({term}, '[''’]s$', '')"
    out = "w0"
    inner = f"(SELECT {bare} AS w0)"
    for number, rules in enumerate(STEM_STEPS[1:]):
        case = f"w{number}"
        for ending, condition, new in reversed(rules):
            test, rewritten = _stem_tests(ending, condition)
            case = f"CASE WHEN regexp_matches(w{number}, '{test}') THEN regexp_replace(w{number}, '{rewritten}', '\\1{new}') ELSE {case} END"
        inner = f"(SELECT w0, {case} AS w{number + 1} FROM {inner})"
        out = f"w{number + 1}"
    return f"(SELECT CASE WHEN regexp_matches(w0, '^[a-z]{{3,}}$') THEN {out} ELSE w0 END FROM {inner})"
