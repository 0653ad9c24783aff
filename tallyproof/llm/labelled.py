"""Bounded samples of labelled rows for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many bytes are not fitted on unless the caller says otherwise (they are scored whole like all others).
LONGEST = 200_000
#: Bytes of texts that a sample brings to the driver at most.
MOST_BYTES = 512 << 20
#: Tables with more labels than this are refused, as each is one query and a part of the model.
MOST_LABELS = 1000


def sample(
    docs: DataFrame, labels: DataFrame, label: Column, fit: Column, most: int, longest: int = LONGEST, most_bytes: int = MOST_BYTES
) -> tuple[list[tuple[str, object]], dict]:
    """At most ``most`` (text, label) rows of each label, one a doc_id, those with the lowest id hashes; and all labels' counts.

    ``labels`` holds doc_id and what ``label`` and ``fit`` are built from; only rows where
    ``fit`` holds and the label is not null take part. One pass counts the labels, another
    takes the ids below a hash bound set by the count, which lets about twice ``most`` a label in.
    Only then are texts fetched: ``most`` a label, each of at most ``longest`` bytes and of at most an equal share of ``most_bytes``,
    which bounds what reaches the driver, however large the tables and however many the labels are.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", label.alias("label"), fit.alias("fit")).filter("fit and label is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to fit on")
    if not counts:
        return [], counts
    schema = f"label {known.schema['label'].dataType.simpleString()}, share double"
    share = spark.createDataFrame([(y, (2.0 * most + 100) / n) for y, n in counts.items()], schema)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    low = known.join(F.broadcast(share), "label").select("doc_id", "label", place.alias("place"), "share").filter(F.col("place") / F.lit(2.0**63) < F.col("share"))
    of: dict[int, object] = {}
    left = dict.fromkeys(counts, most)
    for r in sorted(low.collect(), key=lambda r: (r["place"], r["doc_id"])):
        if left[r["label"]]:
            left[r["label"]] -= 1
            of[r["doc_id"]] = r["label"]
    longest = min(longest, most_bytes // (most * len(counts)))
    ids = spark.createDataFrame([(i,) for i in of], "doc_id long")
    texts = (
        docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    )
    return [(r["text"], of[r["doc_id"]]) for r in sorted(texts.collect(), key=lambda r: r["doc_id"])], counts
