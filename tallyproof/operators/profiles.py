"""Issuer profiles: the caller's words and conventions, and plans that take each statement's own.

A corpus holds statements of many issuers. The profile's key is a column; ``by_profile`` turns one
field of all profiles into one expression that picks by that column, so that a mixed corpus is read in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """An issuer's words; all are patterns. ``markers`` capture an account's name in their first group.

    ``fingerprints``: patterns and weights that tell the issuer. ``running_balance``: the right-most money column prints
    balances. ``require_section``: dated lines outside known headings are no rows. ``charges``: for cards, (label, word, title)
    of what only the summary prints; a row whose description holds the word already names it.
    """

    key: str = "generic"
    fingerprints: tuple[tuple[str, int], ...] = ()
    credit_headings: tuple[str, ...] = ()
    debit_headings: tuple[str, ...] = ()
    credit_words: tuple[str, ...] = ()
    debit_words: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    begin_labels: tuple[str, ...] = ()
    end_labels: tuple[str, ...] = ()
    stops: tuple[str, ...] = ()
    resumes: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    charges: tuple[tuple[str, str, str], ...] = ()
    section_first: bool = False
    default_direction: int = 0
    running_balance: bool = False
    require_section: bool = False
    card: bool = False
    card_explicit: int = 1


def by_profile(profiles: Sequence[Profile], made: Callable[[Profile], Column | None], none: Column) -> Column:
    """What ``made`` gives for the profile that the column ``key`` names; ``none`` for a key without one.

    Profiles with equal fields share a branch where ``made`` returns equal columns' text.
    """
    branches: dict[str, tuple[list[str], Column]] = {}
    for p in profiles:
        column = made(p)
        if column is not None:
            branches.setdefault(str(column), ([], column))[0].append(p.key)
    out = None
    for keys, column in branches.values():
        when = F.col("key").isin(keys)
        out = F.when(when, column) if out is None else out.when(when, column)
    return none if out is None else out.otherwise(none)


def says(profiles: Sequence[Profile], field: str, text: Column) -> Column:
    """Whether the text holds one of the profile's patterns of a kind, in any case."""
    def one(p: Profile) -> Column | None:
        patterns = getattr(p, field)
        return text.rlike("(?i)(?:" + "|".join(patterns) + ")") if patterns else None

    return by_profile(profiles, one, F.lit(False))


def flag(profiles: Sequence[Profile], field: str) -> Column:
    """A yes or no of the profile."""
    keys = [p.key for p in profiles if getattr(p, field)]
    return F.col("key").isin(keys) if keys else F.lit(False)


def best_profile(head: Column, prints: Sequence[tuple[int, str, str, int]]) -> Column:
    """struct(score, before, key) of the highest sum of fingerprint weights on ``head``, null where nothing matches.

    ``prints``: (ordinal, key, pattern, weight); each counts once, in any case; of equal sums the lower ordinal wins.
    """
    terms: dict[tuple[int, str], Column] = {}
    for ordinal, key, pattern, weight in prints:
        hit = F.when(head.rlike("(?i)" + pattern), weight).otherwise(0)
        terms[ordinal, key] = terms[ordinal, key] + hit if (ordinal, key) in terms else hit
    each = [F.struct(v.cast("int").alias("score"), F.lit(-o).alias("before"), F.lit(k).alias("key")) for (o, k), v in sorted(terms.items())]
    best = F.array_max(F.filter(F.array(*each), lambda x: x["score"] > 0)) if each else F.lit(None)
    return best.cast("struct<score:int,before:int,key:string>")


def confidence(score: Column) -> Column:
    """How sure a score makes of its profile, in percent; null scores (no match) 50."""
    return F.when(score.isNull(), 50).when(score >= 40, F.least(F.lit(97), score + 30)).otherwise(F.greatest(F.lit(40), score))
