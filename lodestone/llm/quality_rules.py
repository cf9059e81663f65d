"""Operator 4: line-first cleaning rules, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30  #: words; percent of words in repeated windows
MOST_LOST = 0.5  #: share of a text's word characters that its failing lines may hold
#: Phrases of notices that say nothing about a page's subject.
BOILERPLATE = r"(?i)all rights reserved|licen[sc]ed under|released under the|terms of (use|service)|privacy policy|cookie|enable javascript|sign up|log in to|click here|subscribe to|share (this|on)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_verdict(line: Column) -> Column:
    """The first rule that a line fails: ``navigation``, ``punctuation`` or ``boilerplate``; null if none.

    Navigation: a separator bar for every fourth word or more. Punctuation: as many symbols
    ``#*$%&<>`` as words, or an exclamation mark for every third word. Boilerplate: a short line
    with a phrase of ``BOILERPLATE``.
    """
    n = F.regexp_count(line, F.lit(f"{WORD}+"))
    bars, marks, symbols = _count(line, "|"), _count(line, "!"), _count(line, "#*$%&<>")
    return (
        F.when((bars >= 2) & (4 * bars >= n), "navigation")
        .when((symbols >= 3) & (symbols >= n) | (marks >= 3) & (3 * marks >= n), "punctuation")
        .when((n <= 25) & line.rlike(BOILERPLATE), "boilerplate")
    )


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text, the first included."""

    def covered(sorted_: Column) -> Column:
        """From (hash, position) in order: positions whose hash a neighbour shares, then the union of their windows."""
        last = F.size(sorted_) - 1
        twin = lambda x, i: F.when((i > 0) & (sorted_[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]) | (i < last) & (sorted_[F.least(i + 1, last)]["h"] == x["h"]), x["p"])
        positions = F.array_sort(F.filter(F.transform(sorted_, twin), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + (p + WINDOW - F.greatest(p, acc["end"]))).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(positions, start, step, lambda acc: acc["n"])

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs(h), covered)).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(w) > WINDOW, let(hashes, some)).otherwise(F.lit(0).cast("long"))

    return of(words)


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; lines without a word stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: line_verdict(x).isNull()), "\n")


def facts(text: Column) -> Column:
    """What the verdict rests on, as one struct."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    word_chars = lambda x: F.length(F.regexp_replace(x, SPACE, ""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.aggregate(x, F.lit(0), lambda n, y: n + F.when(line_verdict(y).isNotNull(), word_chars(y)).otherwise(0)).cast("long").alias("lost_chars"),
    )
    return F.struct(let(words_of(whole), of_words).alias("words"), let(lines, of_lines).alias("lines"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def base_failed(f: Column) -> Column:
    n = f["words"]["n_words"]
    return (n < MIN_WORDS) | (100 * f["words"]["n_repeat_words"] > MOST_REPEATED * n)


def is_kept(f: Column) -> Column:
    return ~base_failed(f) & (f["lines"]["lost_chars"] <= MOST_LOST * f["words"]["word_chars"])


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text``.

    Each line is judged first (``line_verdict``). A text is rejected if it has fewer than 20
    words, if over 30 % of its words are in repeated windows of eight words, or if its failing
    lines hold more than half of its word characters. A null or empty text has no words and
    fails. ``clean_text`` is the text without its failing lines, of rejected rows too; null stays
    null. Every row is judged alone, so repeated rows get equal verdicts and an empty table none.
    New columns replace clashing ones.
    """
    f = F.col("__facts")
    out = docs.withColumn("__facts", facts(F.col(text)))
    return out.withColumns({
        "n_words": f["words"]["n_words"],
        "word_chars": f["words"]["word_chars"],
        "n_symbols": f["n_symbols"],
        "n_dup_lines": f["lines"]["n_dup_lines"],
        "n_repeat_words": f["words"]["n_repeat_words"],
        "base_failed": base_failed(f),
        "lost_chars": f["lines"]["lost_chars"],
        "kept": is_kept(f),
        "clean_text": clean_lines(F.col(text)),
    }).drop("__facts")


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and with their own columns only."""
    return docs.withColumn("__facts", facts(F.col(text))).filter(is_kept(F.col("__facts"))).drop("__facts")
