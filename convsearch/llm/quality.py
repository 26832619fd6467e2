"""Quality rules, line first, in DataFrame operations only.

Method: every line is judged by itself; lines that fail go, and a document is
rejected when it loses too many of its words. A line fails when it

* repeats an earlier line of the document,
* is navigation: at least ``nav_bars`` stand-alone ``|`` and one for every
  ``nav_words`` words or more,
* is cluttered: more than ``symbol_rate`` of the symbols ``#*$%&|<>`` a word,
* shouts: at least ``shout_letters`` letters A-Z, over twice its letters a-z,
* stammers: at least ``stammer_words`` words of which under a quarter differ,
* is boilerplate: at most ``boiler_words`` words and one of the fixed phrases,
* lacks punctuation: at least ``open_words`` words and none of ``.!?:;`` at
  all, nor their full-width forms, nor the sentence marks of other scripts.

Words are runs of characters other than space and U+0009-U+000D, lines are
split at line feeds, lines without a word are no lines.

Defined cases: null text counts as empty; a text without words has counts 0,
fails the base rules and is not kept; ``clean`` gives it an empty text; ties
do not arise (the first of equal lines stays); extra columns pass through
``clean`` untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let

SYMBOLS = "#*$%&|<>"
# fixed values: marks that end or part sentences, Latin and full-width, then
# ellipsis, Devanagari, Arabic, Armenian, Ethiopic, Khmer, Myanmar, Tibetan
SENTENCE_MARKS = "[.!?:;。！？：；｡…।॥؟؛۔։።፧។။།]"
# fixed values: phrases of page furniture and legal lines, lower case
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "privacy policy",
    "terms of service", "terms of use", "sign up", "log in", "sign in", "subscribe to", "click here",
    "read more", "skip to content", "back to top", "share this", "follow us",
)
PARAMS = {
    "nav_bars": 2, "nav_words": 4, "symbol_rate": 0.5, "shout_letters": 8, "stammer_words": 8,
    "boiler_words": 12, "open_words": 12, "max_lost": 0.5, "min_words": 50, "max_repeat_pct": 50,
}


def words_of(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for null and blanks."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{WS}+")))


def lines_of(text: Column) -> Column:
    """The lines of ``text`` with a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def symbols(text: Column) -> Column:
    """How many characters are one of ``SYMBOLS``."""
    return F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more among ``words``.

    Windows are compared by 64-bit hash. Texts without equal windows, nearly
    all, are told by a hash set; the others sort their windows."""
    def covered(at):
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, b: a + b)

    def equal(s):
        def same(x, k):
            return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

        there = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return let(F.sort_array(F.filter(there, lambda i: i.isNotNull())), covered)

    def from_hashes(h):
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(placed), equal))

    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes(w), from_hashes)))


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_fails(line: Column, words: Column, p: dict) -> Column:
    """Whether a line with these words fails one of the rules on single lines."""
    n = F.size(words)
    bars = F.size(F.filter(words, lambda w: w == "|"))
    phrase = let(F.lower(line), lambda x: F.greatest(*[F.contains(x, F.lit(y)) for y in BOILERPLATE]))
    capitals = let(_count(line, "[A-Z]"), lambda c: (c >= p["shout_letters"]) & (c > 2 * _count(line, "[a-z]")))
    return (
        (symbols(line) > n * p["symbol_rate"])
        | ((bars >= p["nav_bars"]) & (bars * p["nav_words"] >= n))
        | capitals
        | ((n >= p["stammer_words"]) & (4 * F.size(F.array_distinct(words)) < n))
        | ((n <= p["boiler_words"]) & phrase)
        | ((n >= p["open_words"]) & ~F.regexp_like(line, F.lit(SENTENCE_MARKS))))


def good_lines(lines: Column, p: dict) -> Column:
    """(line, words) of the lines that pass, the first of equal ones only."""
    judged = F.transform(F.array_distinct(lines), lambda x: let(words_of(x), lambda w: F.struct(
        x.alias("line"), F.size(w).alias("n"), line_fails(x, w, p).alias("fails"))))
    return F.filter(judged, lambda x: ~x["fails"])


def assess(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_kept_words, clean_text and kept to ``docs``."""
    p = PARAMS | params
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = let(text, lambda t: let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols(t).cast("long").alias("n_symbols"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
        let(lines_of(t), lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"),
            let(good_lines(x, p), lambda g: F.struct(
                F.array_join(g["line"], "\n").alias("text"),
                F.aggregate(g["n"], F.lit(0), lambda a, b: a + b).cast("long").alias("n"))).alias("good"))).alias("lines"))))
    out = docs.withColumn("_stats", stats)
    n, good = F.col("_stats.n_words"), F.col("_stats.lines.good")
    failed = (n < p["min_words"]) | (100 * F.col("_stats.n_repeat_words") > p["max_repeat_pct"] * n)
    return out.withColumns({
        **{x: F.col(f"_stats.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_repeat_words")},
        "n_dup_lines": F.col("_stats.lines.n_dup"), "base_failed": failed, "kept": ~failed & (good["n"] >= (1 - p["max_lost"]) * n),
        "n_kept_words": good["n"], "clean_text": good["text"]}).drop("_stats")


def clean(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The kept documents, their failed lines removed, with the same columns.
    An ``n_chars`` column follows the new text."""
    names = docs.columns
    judged = assess(docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("_text")), "_text", **params)
    new = {text_col: F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast("long")} if "n_chars" in names else {})
    row = F.struct(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
    # a generator, as a filter would be pushed below and judge each text twice
    out = judged.select(F.explode_outer(F.when(F.col("kept"), F.array(row))).alias("row"))
    return out.filter(F.col("row").isNotNull()).select("row.*")
