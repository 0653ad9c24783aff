"""Completeness and golden comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money_in_text


def printed_not_captured(texts: DataFrame, captured: DataFrame) -> DataFrame:
    """(doc_id, value) of every figure that a document prints and no captured row holds.

    ``texts``: doc_id, text; ``captured``: doc_id, amount, description. Figures in captured
    descriptions count as captured. Both sides are sets, distinct before they meet.
    """
    printed = texts.select("doc_id", F.explode(F.array_distinct(money_in_text(F.col("text")))).alias("value")).distinct()
    figures = F.concat(F.array(F.abs("amount").cast("decimal(18,2)")), F.coalesce(money_in_text(F.col("description")), F.array()))
    held = captured.select("doc_id", F.explode(F.array_distinct(figures)).alias("value")).filter("value is not null").distinct()
    return printed.join(held, ["doc_id", "value"], "left_anti")


def golden_compare(found: DataFrame, golden: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows that differ: keys, side (``missing``, ``extra`` or ``changed``) and the changed fields' names."""
    a = golden.select(*keys, F.struct(*fields).alias("want"), F.lit(True).alias("in_golden"))
    b = found.select(*keys, F.struct(*fields).alias("have"), F.lit(True).alias("in_found"))
    both = a.join(b, keys, "full")
    names = F.array(*(F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}")), F.lit(f)) for f in fields))
    side = F.when(F.col("in_found").isNull(), "missing").when(F.col("in_golden").isNull(), "extra").otherwise("changed")
    changed = F.array_join(F.filter(names, lambda n: n.isNotNull()), ",")
    return both.select(*keys, side.alias("side"), F.when(side == "changed", changed).otherwise("").alias("fields")).filter("side <> 'changed' or fields <> ''")
