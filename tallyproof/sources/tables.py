"""Readers of input tables and writers of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, conf double"
OCR_WORDS = "doc_id string, page int, word_idx int, left int, top int, width int, height int, conf double, text string"
PAGE_TEXT = "doc_id string, page int, text string"


def catalogue(spark: SparkSession, directory: str) -> DataFrame:
    """A1: path, length and time of the PDF files of a directory (any case), contents never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(directory)
    return files.select("path", "length", "modificationTime")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A2: word boxes."""
    return spark.read.schema(WORDS).parquet(path)


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """A3: word boxes of scans, tab-separated with a header."""
    return spark.read.schema(OCR_WORDS).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """A4: page texts."""
    return spark.read.schema(PAGE_TEXT).parquet(path)


def claim_run(spark: SparkSession, path: str, run_id: str, owner: str) -> None:
    """Makes ``owner`` the only writer of a run; raises ValueError if it is another's.

    A claim is a folder that holds its owner's name. It is made elsewhere and moved into place, which one mover alone can do, as a
    folder that isn't empty is never replaced; whoever's name then stands there has the run. So an owner may come back to a run that it was cut short in.
    """
    jvm = spark.sparkContext._jvm
    claim, mine = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{x}") for x in (run_id, f"_{run_id}-{uuid.uuid4().hex}"))
    fs = claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    name = lambda folder: jvm.org.apache.hadoop.fs.Path(folder, "owner")
    if not fs.exists(claim):
        out = fs.create(name(mine))
        out.writeUTF(owner)
        out.close()
        fs.rename(mine, claim)
    held = fs.open(name(claim))
    said = held.readUTF()
    held.close()
    if said != owner:
        raise ValueError(f"run {run_id} is another's: {claim}")


def write_results(results: DataFrame, path: str, run_id: str, *, by_state: bool = False, owner: str | None = None) -> None:
    """A5-A10: append a run's rows under its own run_id; never over another run's.

    The run is claimed first, then written beside, then moved into place as one folder: readers see all of it or nothing. A run that is in place is never
    written again. ``owner``: a name under which a writer that was cut short may go on; without one it may not. With ``by_state`` the rows of proven and unproven
    documents go to route=processed, those of failed ones to route=failed.
    """
    spark = results.sparkSession
    root, own = path.rstrip("/"), owner or uuid.uuid4().hex
    place = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    target, staged = place(f"{root}/run_id={run_id}"), place(f"{root}/_staged/{run_id}-{own}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"run {run_id} is there already: {target}")
    claim_run(spark, path, run_id, own)
    writer = results
    if by_state:
        writer = results.withColumn("route", F.when(F.col("state") == "failed", "failed").otherwise("processed"))
    out = writer.write.mode("overwrite")
    (out.partitionBy("route") if by_state else out).parquet(staged.toString())
    if not fs.rename(staged, target):
        raise ValueError(f"run {run_id} could not be moved into place: {target}")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share (``spark.checkpoint.dir``, else under the warehouse) and read again: its lineage ends here.

    It is packed by zstd, as it stays on disk until the folder is cleared.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, *keys: str, rows_each: int = 400_000) -> DataFrame:
    """``table``, as it is read, dealt by ``keys`` into parts of about ``rows_each`` rows, as many as that takes.

    What is then sorted, windowed or grouped by these keys is shuffled no more, and no task's memory grows with the table. Counting reads the files' footers alone.
    """
    n = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows_each))
    return table.repartition(n, *keys)
