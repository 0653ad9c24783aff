"""Incremental runs over a folder that new files are dropped into."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(
    spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *,
    archive: str | None = None,
) -> None:
    """Takes every file once that came since the last run, runs ``process`` on it and appends the rows to ``out``.

    A document is whole in one file, so no state passes between batches. Each batch is written
    under its own number with overwrite: a batch that was cut short is written anew, not
    twice. With ``archive`` finished files are moved there by the source itself.
    """
    reader = spark.readStream.schema(schema)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def batch(rows: DataFrame, number: int) -> None:
        process(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


LOG = "path string, state string, reason string, rows long"


def ingest_documents(
    spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, suffix: str = "parquet", files_a_batch: int = 1000
) -> None:
    """Like ``ingest``, but a document that can't be read or processed fails alone.

    Each file of ``source`` that ends in ``suffix`` is a document. A batch (at most ``files_a_batch`` files) is processed at once; if that fails, its halves are, and so on
    down to the single documents that fail by themselves. Results go to ``out``/results and the log to ``out``/log, a row a document: path, state
    (read, empty or failed), reason (the error's first line) and rows read. Both are written under the batch's number with overwrite, results first, so a batch that was cut short is
    written anew. Where every document of a batch of several fails, the batch raises: then the job is at fault, not the documents.
    Only the batch's file names and the error reach the driver.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("maxFilesPerTrigger", files_a_batch)
    names = files.schema("path string, modificationTime timestamp, length long, content binary").load(source).select("path")

    def attempt(paths: list[str], lo: int, folder: str) -> list[tuple[str, str, str, int]]:
        """The log rows of some of a batch's documents; their results are written on the way."""
        part = f"{folder}/part={lo}-{lo + len(paths)}"
        try:
            rows = spark.read.schema(schema).parquet(*paths)
            process(rows).write.mode("overwrite").parquet(part)
            read = {r["path"]: r["count"] for r in rows.groupBy(F.col("_metadata.file_path").alias("path")).count().collect()}
            plain = {_plain(k): v for k, v in read.items()}
            return [(p, "read" if _plain(p) in plain else "empty", "", plain.get(_plain(p), 0)) for p in paths]
        except (PySparkException, Py4JJavaError) as e:  # the latter is what a batch function gets
            write_nothing(part)
            if len(paths) == 1:
                said = e.java_exception.toString() if isinstance(e, Py4JJavaError) else str(e)
                return [(paths[0], "failed", said.strip().split("\n")[0][:300], 0)]
            half = len(paths) // 2
            return attempt(paths[:half], lo, folder) + attempt(paths[half:], lo + half, folder)

    def write_nothing(part: str) -> None:
        """Takes away what a failed write may have left."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def batch(rows: DataFrame, number: int) -> None:
        folder = f"{out}/results/batch={number}"
        write_nothing(folder)
        paths = sorted(r["path"] for r in rows.collect())
        if not paths:
            return
        log = attempt(paths, 0, folder)
        if len(log) > 1 and all(state == "failed" for _, state, _, _ in log):
            raise RuntimeError(f"every document of batch {number} failed, the first with: {log[0][2]}")
        spark.createDataFrame(log, LOG).coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch={number}")

    query = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _plain(path: str) -> str:
    """A path without its scheme, percent signs decoded, as sources spell it in several ways."""
    return unquote(urlsplit(path).path if "://" in path or path.startswith("file:") else path)
