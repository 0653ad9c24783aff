"""Quality rules: a threshold table compiled into one projection.

All measures are expressions over the text alone, so the plan is a scan and
projections: no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked

BLANKS = r"[\x20\x09-\x0D]+"

#: Frequent function words by language; ordinary prose holds some of one of them.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "a", "that", "for", "on", "with", "as", "by", "it"),
    "fr": ("le", "la", "les", "de", "et", "des", "un", "une", "en", "que", "qui", "du", "pour", "dans"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "ein", "eine", "mit", "ist", "auf", "des"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "un", "una", "con", "por"),
}


@dataclass(frozen=True)
class Rule:
    """Kept only if low <= measure <= high; None leaves an end open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios of documents that are kept.
RULES = (
    Rule("words", "n_words", low=10),
    Rule("repeated_words", "repeat_ratio", high=0.20),
    Rule("mean_word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("symbols_per_word", "symbol_ratio", high=0.30),
    Rule("stop_words_per_word", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.30),
)


def _windows_found_again(words: Column, size: int) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the array.

    Windows are compared by a 64-bit hash. Only where two hashes agree are the windows
    sorted, so most texts pay for one hashed distinct; nothing is quadratic in the length.
    """
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - F.lit(size - 1)),
        lambda i: F.xxhash64(*(F.get(words, i + F.lit(k - 1)) for k in range(size))),
    )

    def again(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        kept = lambda s: F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        )
        places = lambda s: F.array_sort(F.transform(kept(s), lambda x: x["i"]))
        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
            F.lit(0), lambda a, x: a + x,
        )
        return _let(pairs, lambda s: _let(places(s), covered))

    return F.when(n < size, F.lit(0)).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(again(h)))
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_measures(rows: DataFrame) -> DataFrame:
    """Adds the counts and ratios of ``text`` (null: no words)."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    stop_set = r"(?<![^\x20\x09-\x0D])(?:" + "|".join(stop) + r")(?![^\x20\x09-\x0D.,;:!?])"
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", F.filter(F.split(text, BLANKS), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *(c for c in rows.columns if c != "words"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _windows_found_again(F.col("words"), 5).cast("long").alias("n_repeat_words"),
        F.regexp_count(F.lower(text), F.lit(stop_set)).cast("long").alias("n_stop_words"),
    )
    some = F.greatest("n_words", F.lit(1))
    return rows.withColumns(
        {
            "mean_word_length": F.col("word_chars") / some,
            "symbol_ratio": F.col("n_symbols") / some,
            "stop_ratio": F.col("n_stop_words") / some,
            "repeat_ratio": F.col("n_repeat_words") / some,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        }
    )


def compiled(rules=RULES) -> Column:
    """The table as one expression: the names of the rules that a row fails, in table order."""
    tests = []
    for r in rules:
        low = F.col(r.measure) < r.low if r.low is not None else F.lit(False)
        high = F.col(r.measure) > r.high if r.high is not None else F.lit(False)
        tests.append(F.when(low | high, F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def quality(docs: DataFrame, *, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the base rule and the verdict of the threshold table, a row for each document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept (boolean), failed_rules (array of names). base_failed: under 10 words, or more than a
    fifth of the words in repeated 5-word windows; such rows are never kept. Null and empty
    texts have no words and so fail. Repeated ids stay apart; an empty table stays empty.
    """
    rows = with_measures(picked(docs, id_col, text_col))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = compiled(rules)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"),
    )
