"""Ordered scans of keys that may hold any number of rows, in two levels.

A window over a key holds all of its rows in one task. Here rows are dealt by ranges of key and order,
so a large key lies in several chunks, one after the other. What a scan carries along is worked out within each chunk; one row a
chunk then carries it over the chunks. No task holds more of a key than a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_table

CHUNK = "chunk"


def chunked(rows: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """``rows`` with the column chunk, which grows with (keys, order), written to the shared folder so that every reader sees the same chunks.

    ``chunks``: how many in all; the shuffle's number of partitions if not given. Rows alike in keys and order share one.
    """
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop(CHUNK).repartitionByRange(n, *keys, *order)
    return shared_table(dealt.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _within(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def count_before(rows: DataFrame, keys: list[str], order: list[str], counts: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``counts`` (whole numbers) over the rows of the key before this one. ``rows``: as from chunked."""
    rows = rows.withColumn("_c", F.coalesce(counts, F.lit(0)).cast("long"))
    sums = rows.groupBy(*keys, CHUNK).agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, CHUNK, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    local = F.sum("_c").over(_within(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(offsets, [*keys, CHUNK]).withColumn(name, F.col("_o") + F.coalesce(local, F.lit(0))).drop("_c", "_o")


def last_so_far(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null, over the rows of the key up to this one. ``rows``: as from chunked."""
    rows = rows.withColumn("_v", value)
    lasts = rows.filter("_v is not null").groupBy(*keys, CHUNK).agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    every = rows.select(*keys, CHUNK).distinct().join(lasts, [*keys, CHUNK], "left")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, CHUNK, F.last("_l", ignorenulls=True).over(before).alias("_p"))
    local = F.last("_v", ignorenulls=True).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(carried, [*keys, CHUNK]).withColumn(name, F.coalesce(local, "_p")).drop("_v", "_p")
