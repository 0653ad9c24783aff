"""Places of pattern matches by built-in functions alone.

Spark has no function that returns where all matches begin. A text split at its matches
gives the gaps between them; gap and match lengths in code points, summed up, give the
places. Sums go by blocks of matches, so that a text with very many stays far from
quadratic work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _upto(n: Column) -> Column:
    """0 to n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sums_before(x: Column) -> Column:
    """For each element of an int array the sum of those before it."""

    def by_block(sums: Column) -> Column:
        heads = F.transform(_upto(F.size(sums)), lambda c: _sum(F.slice(sums, F.lit(1), c)))
        return let(
            heads,
            lambda h: F.transform(
                x,
                lambda _, i: F.get(h, (i / _BLOCK).cast("int"))
                + _sum(F.slice(x, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
            ),
        )

    blocks = F.transform(
        _upto(((F.size(x) + (_BLOCK - 1)) / _BLOCK).cast("int")), lambda c: _sum(F.slice(x, c * _BLOCK + 1, F.lit(_BLOCK)))
    )
    return let(blocks, by_block)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches that don't overlap, from left to right.

    array<struct<s int, e int, m string, g string, l string, r string>>: start and end in code
    points (end exclusive), the match, one group of it, up to 24 characters on its left
    (none of the match before) and one on its right. The pattern may not match the empty text.
    """

    def placed(x: Column) -> Column:
        gaps, ms = x["gaps"], x["ms"]
        steps = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            _sums_before_of(steps),
            lambda before: F.transform(
                ms,
                lambda m, i: F.struct(
                    (F.get(before, i) + F.length(F.get(gaps, i))).alias("s"),
                    (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("e"),
                    m.alias("m"),
                    F.get(x["gs"], i).alias("g") if group else m.alias("g"),
                    F.right(F.get(gaps, i), F.lit(24)).alias("l"),
                    F.left(F.get(gaps, i + 1), F.lit(1)).alias("r"),
                ),
            ),
        )

    parts = [
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"),
    ]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("gs"))
    return let(F.struct(*parts), placed)


def _sums_before_of(steps: Column) -> Column:
    return let(steps, _sums_before)


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<s:int,e:int,m:string,g:string,l:string,r:string>>")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs with k, s and e."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
