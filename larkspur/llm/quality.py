"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every metric is a JVM expression over the row itself, so scoring is a single scan without
shuffle, user function or collected state, and a document of any length is one row's work.

Defined results
* null text counts as the empty text: no words, every ratio null, ``base_failed``, not kept.
* a ratio whose denominator is zero is null; a rule on a null ratio passes (the base decides).
* repeated rows, ties and null ids are scored independently; other columns pass through only
  if asked for with ``keep``; names that clash with a metric are dropped in favour of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, let, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "au", "des", "du", "elle", "et", "il", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une",
    "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "de", "del", "el", "en", "es", "los", "no", "para", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= numerator / denominator <= most``; either bound may be absent."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None = None
    most: float | None = None

    @property
    def ratio(self) -> str:
        return f"{self.name}_ratio"


#: The production thresholds. Numerators and denominators are metrics of ``measures``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol", "n_symbols", "n_words", None, 0.3),
    Rule("exclamation", "n_exclamations", "n_words", None, 0.3),
    Rule("stop_word", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line", "n_dup_lines", "n_lines", None, 0.5),
)
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def _count(text: Column, characters: str) -> Column:
    """Occurrences of any of some ASCII characters."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


#: A window's position takes the low bits of its packed key; longer texts sort the windows themselves.
POSITION_BITS = 20


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Windows are packed as (hash prefix, position) and sorted as plain longs. Equal windows have
    equal prefixes, so only windows beside one of the same prefix are compared word for word.
    """
    window = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(*window(i)), POSITION_BITS) + i)

    def suspects(keys: Column) -> Column:
        prefix = lambda e: F.shiftright(e, POSITION_BITS)
        same = lambda e, j: F.coalesce(prefix(F.get(keys, j)) == prefix(e), F.lit(False))
        beside = F.filter(keys, lambda e, j: same(e, j + 1) | same(e, j - 1))
        return F.transform(beside, lambda e: (e - F.shiftleft(prefix(e), POSITION_BITS)).cast("int"))

    def covered(starts: Column) -> Column:
        keyed = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["k"] == e["k"], F.lit(False))
            twice = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return let(keyed, positions)

    candidates = F.when(F.size(words) < 1 << POSITION_BITS, let(F.sort_array(packed), suspects)).otherwise(starts)
    return let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(covered(c)))


def measures(text: Column) -> Column:
    """One struct of counts (all long) for a text."""

    def of_words(words: Column, lines: Column) -> Column:
        number = lambda c: c.cast("long")
        return F.struct(
            number(F.size(words)).alias("n_words"),
            number(F.length(F.concat_ws("", words))).alias("word_chars"),
            number(_count(text, SYMBOLS)).alias("n_symbols"),
            number(_count(text, "!")).alias("n_exclamations"),
            number(F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))).alias("n_stop_words"),
            number(F.size(lines)).alias("n_lines"),
            number(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            number(_repeat_words(words)).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(WHITESPACE)) != "")
    return let(F.struct(words_of(text).alias("words"), lines.alias("lines")), lambda v: of_words(v["words"], v["lines"]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Metrics, ratios and verdict of every document: the columns in ``keep``, then
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    the further counts, one ``<rule>_ratio`` and the names of the rules it failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")
    taken = {*names, "base_failed", "kept", "failed_rules", *(r.ratio for r in rules)}
    kept = [c for c in keep if c not in taken]
    scored = docs.select(*kept, text_or_empty(text).alias("__text")).select(*kept, measures(F.col("__text")).alias("__m"))
    m = lambda name: F.col(f"__m.{name}")
    ratio = lambda r: m(r.numerator) / F.nullif(m(r.denominator), F.lit(0)) if r.denominator else m(r.numerator).cast("double")

    def fails(r: Rule) -> Column:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (ratio(r) < r.least)
        if r.most is not None:
            bad = bad | (ratio(r) > r.most)
        return F.coalesce(bad, F.lit(False))

    base = (m("n_words") < LEAST_WORDS) | (100 * m("n_repeat_words") > MOST_REPEATED_PERCENT * m("n_words"))
    broken = F.filter(F.array(*(F.when(fails(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    passed = ~base
    for r in rules:
        passed = passed & ~fails(r)
    return scored.select(*kept, *(m(n).alias(n) for n in names[:5]), base.alias("base_failed"), passed.alias("kept"), *(m(n).alias(n) for n in names[5:]), *(ratio(r).alias(r.ratio) for r in rules), broken.alias("failed_rules"))
