"""Facts of whole documents: native text, kinds, issuer profiles, statements, periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import _MONTHS, _day, let
from .profiles import best_profile, confidence

#: Only so much of a statement's head is looked at for its issuer.
HEAD = 6000
CATCH_ALL = "generic"


def document_text(pages: DataFrame) -> DataFrame:
    """A4: one row a document; its pages in order, joined by line ends."""
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text")
    )


def native_or_scan(pages: DataFrame, least: int = 200) -> DataFrame:
    """B1: chars, pages, is_native: at least 200 characters for each three pages (for one to five: 200)."""
    facts = pages.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("pages"))
    return facts.withColumn("is_native", F.col("chars") >= least * F.greatest(F.lit(1), F.floor(F.col("pages") / 3)))


def kind_of(text: Column, kinds: list[tuple[str, list[str]]]) -> Column:
    """B2: the first kind all of whose patterns occur; null if none. The kinds are the caller's data."""
    out = None
    for kind, patterns in kinds:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & text.rlike(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(None).cast("string") if out is None else out


def profile_scores(docs: DataFrame, profiles: DataFrame, patterns: DataFrame, most_patterns: int = 2_000) -> DataFrame:
    """Key, score and confidence of each document's profile.

    ``profiles``: key, ordinal; ``patterns``: key, kind, pattern, weight, of which the kind
    ``fingerprint`` counts, each pattern once and in any case, on the first 6,000 characters.
    The highest sum wins, the earlier profile of equals, the catch-all where nothing matches.
    A ``profile_key`` column of ``docs`` that is not null is taken instead (confidence 97).
    The vocabulary is small by nature: it becomes terms of one projection, and beyond
    ``most_patterns`` rows it is refused.
    """
    prints = patterns.filter("kind = 'fingerprint'").join(profiles.select("key", "ordinal"), "key")
    found = prints.select("key", "ordinal", "pattern", "weight").limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError("too many fingerprints for one projection")
    given = F.col("profile_key") if "profile_key" in docs.columns else F.lit(None).cast("string")
    best = best_profile(F.col("head"), [(r["ordinal"], r["key"], r["pattern"], r["weight"]) for r in found])
    scored = docs.select("doc_id", F.substring("text", 1, HEAD).alias("head"), given.alias("given")).withColumn("b", best)
    sure = F.when(F.col("given").isNotNull(), 97).otherwise(confidence(F.col("b.score")))
    return scored.select(
        "doc_id", F.coalesce("given", F.col("b.key"), F.lit(CATCH_ALL)).alias("key"), F.coalesce(F.col("b.score"), F.lit(0)).alias("score"), sure.alias("confidence")
    )


def starts_statement(text: Column) -> Column:
    """Whether a page says ``Page 1 of n``."""
    return text.rlike(r"(?i)Page\s*1\s*of\s*[0-9]+")


def statement_split(pages: DataFrame) -> DataFrame:
    """stmt_no of each page: a page that says ``Page 1 of n`` starts a new statement, page 1 always does."""
    w = Window.partitionBy("doc_id").orderBy("page")
    starts = starts_statement(F.col("text")) | (F.row_number().over(w) == 1)
    return pages.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("stmt_no", F.sum("_s").over(w)).drop("_s")


def document_profile(statements: DataFrame) -> DataFrame:
    """Of several statements the last with rows gives the profile, else the first. ``statements``: doc_id, stmt_no, key, n_txn."""
    some = F.when(F.col("n_txn") > 0, F.col("stmt_no"))
    return statements.groupBy("doc_id").agg(F.coalesce(F.max_by("key", some), F.min_by("key", "stmt_no")).alias("key"))


def _month_pattern() -> str:
    """A month's name or its first three letters (of September also four), as one group."""
    rest = lambda m: "(?:t(?:ember)?)?" if m == "september" else f"(?:{m[3:]})?" if m[3:] else ""
    return "(" + "|".join(m[:3] + rest(m) for m in _MONTHS) + ")"


_NAMED = _month_pattern() + r"\.?\s+(\d{1,2})"  # month and day
_NUMERIC = r"(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})(?!\d)"
_YEAR = r",?\s*(\d{4})"
_TO = r"\s*(?:[-\u2013]|to|thru|through)\s*"


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit("".join(m[:3] for m in _MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(name != "", F.floor((at + 2) / 3).cast("int"))


def _full_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


PERIOD = "struct<start: date, end: date>"
_FORMS = ("named", "numeric", "one_year", "balances", "single")


def _period_forms(text: Column) -> tuple[dict[str, Column], dict[str, Callable[[Column], Column]], Column]:
    """What each form's first occurrence holds (empty if there is none), the span that such a piece gives, and all full numeric dates.

    A piece is found once and taken apart once: its fields are written side by side and split.
    """
    balance_of = lambda which: rf"{which}\s*balance\s*as\s*of\s*{_NUMERIC}"
    forms = {
        "named": (6, f"(?i){_NAMED}{_YEAR}{_TO}{_NAMED}{_YEAR}"),
        "numeric": (6, f"(?i){_NUMERIC}{_TO}{_NUMERIC}"),
        "one_year": (5, f"(?i){_NAMED}{_TO}{_NAMED}{_YEAR}"),
        "balances": (6, f"(?is){balance_of('previous')}.{{0,300}}?{balance_of('new')}"),
        "single": (3, rf"(?i){_NAMED},\s*(\d{{4}})"),
    }

    def valid(a: Column, b: Column) -> Column:
        between = lambda x: F.when(F.datediff(x["end"], x["start"]).between(0, 400), x)
        return let(F.struct(a.alias("start"), b.alias("end")), between)

    number = lambda g, i: F.get(g, i - 1).try_cast("int")
    month = lambda g, i: _month_number(F.get(g, i - 1))
    named = lambda g, i: _day(number(g, i + 2), month(g, i), number(g, i + 1))
    numeric = lambda g, i: _day(_full_year(number(g, i + 2)), number(g, i), number(g, i + 1))

    def one_year(g: Column) -> Column:
        m1, m2, y = month(g, 1), month(g, 3), number(g, 5)
        return valid(_day(F.when(m1 <= m2, y).otherwise(y - 1), m1, number(g, 2)), _day(y, m2, number(g, 4)))

    spans = {
        "named": lambda g: valid(named(g, 1), named(g, 4)),
        "numeric": lambda g: valid(numeric(g, 1), numeric(g, 4)),
        "one_year": one_year,
        "balances": lambda g: valid(numeric(g, 1), numeric(g, 4)),
        "single": lambda g: let(named(g, 1), lambda end: F.when(end.isNotNull(), F.struct(F.date_sub(end, 35).alias("start"), end.alias("end")))),
    }
    pieces = {f: F.regexp_extract(text, pattern, 0) for f, (_, pattern) in forms.items()}

    def span_of(f: str) -> Callable[[Column], Column]:
        n, pattern = forms[f]
        fields = "|".join(f"${i}" for i in range(1, n + 1))
        return lambda piece: F.when(piece != "", let(F.split(F.regexp_replace(piece, pattern, fields), "[|]"), spans[f])).cast(PERIOD)

    tokens = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}[/-]\d{1,2}[/-](?:\d{4}|\d\d))\b"), F.lit(1))
    as_day = lambda part: _day(_full_year(F.get(part, 2).cast("int")), F.get(part, 0), F.get(part, 1))
    days = F.filter(F.transform(tokens, lambda t: let(F.split(t, "[/-]"), as_day)), lambda d: d.isNotNull())
    return pieces, {f: span_of(f) for f in _FORMS}, days


def _spread(lo: Column, hi: Column, n: Column) -> Column:
    return F.when((n >= 3) & F.datediff(hi, lo).between(0, 400), F.struct(lo.alias("start"), hi.alias("end"))).cast(PERIOD)


def period_marks(text: Column) -> Column:
    """What a text, or one page of it, says of its statement's period.

    A struct with, for each form, struct(hit, span) of its first occurrence, and lo, hi and n of all full numeric dates.
    """
    pieces, spans, days = _period_forms(text)
    said = lambda f: let(pieces[f], lambda p: F.struct(F.coalesce(p != "", F.lit(False)).alias("hit"), spans[f](p).alias("span")))
    dates = lambda d: F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"), F.coalesce(F.size(d), F.lit(0)).alias("n"))
    every = F.struct(*(said(f).alias(f) for f in _FORMS), let(days, dates).alias("d"))
    return let(every, lambda x: F.struct(*(x[f].alias(f) for f in _FORMS), *(x["d"][c].alias(c) for c in ("lo", "hi", "n"))))


def period_of(marks: Column) -> Column:
    """The period of a text's marks."""
    return F.coalesce(*(marks[f]["span"] for f in _FORMS), _spread(marks["lo"], marks["hi"], marks["n"]))


def joined_marks(marks: str, order: str) -> Column:
    """The marks of a statement from those of its pages, as an aggregate: of each form the first page's that has it; all dates."""
    first = [F.min_by(F.col(f"{marks}.{f}"), F.when(F.col(f"{marks}.{f}.hit"), F.col(order))).alias(f) for f in _FORMS]
    return F.struct(*first, F.min(f"{marks}.lo").alias("lo"), F.max(f"{marks}.hi").alias("hi"), F.sum(f"{marks}.n").alias("n"))


def find_period(text: Column) -> Column:
    """struct(start, end) of a statement's period, null if none is found.

    In this order: two dates with month names and years; two numeric dates; two month-name
    dates that share one year (the start may fall in the year before); the dates of a previous and a
    new balance at most 300 characters apart; one month-name date (the 35 days before it); the
    span of three or more full numeric dates. A span is valid from 0 to 400 days.
    """
    pieces, spans, days = _period_forms(text)
    dates = let(days, lambda d: _spread(F.array_min(d), F.array_max(d), F.size(d)))
    return F.coalesce(*(let(pieces[f], spans[f]) for f in _FORMS), dates)


def bundle_label(text: Column, patterns: list[str]) -> Column:
    """What the first of the patterns that occurs captures (its first group), in title case; null if none does."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.initcap(F.trim(F.coalesce(*found))) if found else F.lit(None).cast("string")


def bundle_names(statements: DataFrame, patterns: list[str]) -> DataFrame:
    """``statements`` (doc_id, stmt_no, block_name, text) with the label behind the block name where a document holds several statements."""
    several = statements.groupBy("doc_id").agg(F.count_distinct("stmt_no").alias("_many"))
    label = F.when(F.col("_many") > 1, bundle_label(F.col("text"), patterns))
    return statements.join(several, "doc_id").withColumn("block_name", F.concat_ws(" ", "block_name", label)).drop("_many")


def owner_name(text: Column, first_line: str | None = None, anywhere: str | None = None) -> Column:
    """Whose document it is: what ``first_line`` captures of the first line that isn't blank, else what ``anywhere`` captures."""
    line = F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1))
    tried = [F.regexp_extract(x, p, 1) for x, p in ((line, first_line), (text, anywhere)) if p]
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in tried)) if tried else F.lit(None).cast("string")


def account_number(text: Column, pattern: str) -> Column:
    """What the pattern's first group captures, if it holds four digits or more."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(F.length(F.regexp_replace(found, "[^0-9]", "")) >= 4, found)
