"""A corpus pipeline in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``documents``, any others go. Between stages the rows are written as Parquet and read again.
A stage makes one row of each row that it keeps: repeated rows stay repeated but for the near duplicates, and empty tables stay empty.

Stages with Python workers lower ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session, as that is read only
when their rows are; ``run`` sets it back at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm.byte_bpe import round_trip
from tallyproof.llm.common import stored
from tallyproof.llm.jaccard_join import deduplicated
from tallyproof.llm.secret_ownership import find_secrets, masked
from tallyproof.llm.string_kernel import UNKNOWN, identify
from tallyproof.llm.wu_manber import contamination

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language leads by less than this part of its usual lead go, however many languages there are.
LEAST_LEAD = 0.1
#: Bytes of an Arrow batch, and the setting that holds them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bounds the bytes that go to a Python worker at once, as texts differ in length by thousands; a bound already lower stays."""
    if not spark.conf.get(_BATCH).isdigit() or int(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, as they are; those without letters or any clear language go."""
    _small_batches(spark)
    found = identify(docs, docs, keep=COLUMNS).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lead") >= LEAST_LEAD))
    return found.select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Repeats of one id are documents like others; texts without words are like no other and all stay.
    """
    _small_batches(spark)
    return deduplicated(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts, and all documents where there is no item, stay."""
    _small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items, keep=COLUMNS).filter(~F.col("contaminated"))
    return found.select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked and n_chars follows the text. A null text stays null."""
    found = find_secrets(docs, keep=COLUMNS)
    text = masked(F.col("kept_text"), F.col("places"))
    changed = F.coalesce(F.size("places"), F.lit(0)) > 0
    return found.select(
        F.col("kept_doc_id").alias("doc_id"), text.alias("text"), F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"),
        F.when(changed, F.length(text).cast("long")).otherwise(F.col("kept_n_chars")).alias("n_chars"),
    )


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; a null text counts as empty."""
    _small_batches(spark)
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Language models and token merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
