"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, within: str | None = None, rows_a_part: int = 500_000) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (long columns u, v); label is the component's least node.

    Large star: every node hangs its larger neighbours on its least neighbour. Small star:
    it hangs its smaller neighbours there. The rounds halve paths, so their number is
    logarithmic in the longest path. Each round's edges are written to the shared folder,
    which also cuts the lineage; edges never grow in number, so a round's are written in
    parts of about ``rows_a_part``. Only counts and checksums reach the driver.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", within)
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = stored(small.coalesce(before[0] // rows_a_part + 1), "edges", within)
        after = _state(edges)
        if after == before:
            break
        before = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
