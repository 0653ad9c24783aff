"""Sharding: a two-pass external shuffle.

Pass 1 scatters the records into buckets that fit in memory: the shard by highest
random weight of (seed, doc_id, shard), the bucket inside the shard by another
seeded hash. Pass 2 takes one bucket at a time, puts it in Fisher-Yates order and
writes it. A shard is the run of its buckets, so a reader streams a uniformly
shuffled shard without ever sorting more than one bucket.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, shared_dir


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash of (key, shard).

    Only the key and the number of shards decide. A further shard takes the keys
    whose highest weight is its own and moves no other key. A null key hashes
    like any other value.
    """
    best = F.greatest(
        *(F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards))
    ) if shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n); numpy's shuffle is Fisher-Yates."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def _shuffle_bucket(seed: int):
    def run(key, table):
        shard, bucket = (k.as_py() for k in key)
        # Rows of a bucket arrive in no fixed order: first one that does not depend on the run.
        table = table.sort_by([("mix", "ascending"), ("doc_id", "ascending"), ("crc", "ascending"), ("hash", "ascending")])
        order = fisher_yates(table.num_rows, zlib.crc32(f"{seed}:{shard}:{bucket}".encode()))
        out = table.take(pa.array(order))
        return pa.table(
            {
                "shard": out["shard"], "bucket": out["bucket"],
                "pos": pa.array(np.arange(out.num_rows), pa.int64()),
                "doc_id": out["doc_id"], "text": out["text"],
            }
        )

    return run


def _with_place(rows: DataFrame, most_broadcast: int) -> DataFrame:
    """Adds place: 1, 2, ... for rows of one id and text, null for a row without repeats.

    Repeats are alike, so any numbering gives the same table: one of each such row is kept with its count and
    written out again that many times, and no task has to hold them all. Up to ``most_broadcast`` such rows are broadcast, more are joined by a shuffle.
    """
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    twice = rows.groupBy("doc_id", "crc", "hash").count().filter("count > 1").drop("count")
    found = twice.count()
    if not found:
        return rows.withColumn("place", F.lit(None).cast("long"))
    twice = (F.broadcast(twice) if found <= most_broadcast else twice).alias("b")
    on = [same(c, c) for c in ("doc_id", "crc", "hash")]
    alone = rows.alias("a").join(twice, on, "left_anti").withColumn("place", F.lit(None).cast("long"))
    kept = rows.alias("a").join(twice, on, "left_semi").groupBy("doc_id", "crc", "hash").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    again = kept.select("doc_id", "text", "crc", "hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("place"))
    return alone.unionByName(again)


def external_shuffle(
    docs: DataFrame, *, shards: int = 8, seed: int = 20240229, bucket_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most_broadcast: int = 100_000,
) -> DataFrame:
    """Write ``docs`` as shuffled shards under ``path`` and return the written table.

    Columns: shard int, bucket int, pos long (place in the bucket), doc_id long, text.
    The number of buckets follows from the bytes of the texts, so that a bucket stays near
    ``bucket_bytes``. The bucket hash takes the id and the text, so the same rows and seed
    give the same order however the input files are cut. Repeats of one row are numbered, in any order as they are alike,
    so that thousands of them spread over all buckets of their shard.
    Null texts and ids are kept as they are; an empty table gives an empty result; a
    single text larger than a bucket is a bucket's problem alone (a row can't be split).
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col)
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    rows = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))).withColumn("hash", F.xxhash64(F.lit(seed + 2), "text", F.col("text").isNull()))
    scattered = (
        _with_place(rows, most_broadcast).withColumn("shard", shard_of(F.col("doc_id"), shards, seed))
        .withColumn("mix", F.xxhash64(F.lit(seed + 1), "doc_id", "crc", "place"))
        .withColumn("bucket", F.pmod("mix", F.lit(buckets)).cast("int"))
    )
    shuffled = scattered.groupBy("shard", "bucket").applyInArrow(
        _shuffle_bucket(seed), "shard int, bucket int, pos long, doc_id long, text string"
    )
    path = path or shared_dir(spark, "shards")
    shuffled.sortWithinPartitions("shard", "bucket", "pos").write.partitionBy("shard").parquet(path)
    return (
        spark.read.schema("shard int, bucket int, pos long, doc_id long, text string").parquet(path)
        .select("shard", "bucket", "pos", "doc_id", "text")
    )


def slots(written: DataFrame) -> DataFrame:
    """Adds slot: the gapless place from 0 in the shard (buckets in order, places in them).

    The window runs over one row per bucket, not over the records.
    """
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return written.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("pos")).drop("first")


def shard_digest(docs: DataFrame, *, shards: int = 8, seed: int = 20240229, **kw) -> DataFrame:
    """The shards as one row per record: place, size and checksum, read from the written files."""
    written = external_shuffle(docs, shards=shards, seed=seed, **kw)
    text = F.coalesce("text", F.lit(""))
    small = written.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard", "bucket", "pos",
        shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
    )
    return slots(small).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "bucket")
