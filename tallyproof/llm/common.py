"""Helpers shared by the text operators: shared storage, column picking, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share.

    The folder is what the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset (tests on one machine) a folder under the warehouse is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends here.

    Shuffle files of the write go at its end, as nothing reads them any more.
    ``within``: a folder of the caller's, from shared_dir, that it discards as a whole.
    """
    spark = df.sparkSession
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else shared_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def carried(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> list:
    """The columns of ``keep`` that go through a Python step beside the text, as kept_<c>; the text itself goes once."""
    return [docs[c].alias(f"kept_{c}") for c in keep if c != text_col]


def kept_of(batch: pa.RecordBatch, keep: tuple[str, ...], text_col: str) -> dict:
    """The kept columns of a batch, in the order of kept_schema."""
    return {f"kept_{c}": batch.column("text" if c == text_col else f"kept_{c}") for c in keep}


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """The kept columns' part of a schema string."""
    return "".join(f", `kept_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def picked(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the id (as ``doc_id``), the text (as ``text``) and the columns asked for.

    Whatever else the caller's table holds can't clash with an operator's own columns. Ids
    that are no whole numbers count as null.
    """
    return docs.select(
        docs[id_col].try_cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        *(docs[c] if isinstance(c, str) else c for c in more),
    )


def text_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The UTF-8 bytes of a text column without copies, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = pa.Array.from_buffers(pa.int64(), len(column) + 1, [None, column.buffers()[1]], offset=column.offset)
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), offsets.to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text (or one row) and ``rows`` rows at most.

    Bounds what a Python worker holds at once, however many rows Spark puts in a batch.
    """
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or offsets[i + 1] - offsets[start] > most or i - start >= rows:
                yield batch.slice(start, i - start)
                start = i


def code_points(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null where the id is null."""
    return F.crc32(F.col(column).cast("string"))


#: What parts words of the kind ``[^\\x20\\x09-\\x0D]+``.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
def word_spans(
    data: np.ndarray, offsets: np.ndarray, parted: np.ndarray | None = None, apart: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of many texts in one byte array, and words by text; ``apart``: the bytes between words, blanks.

    Text i is data[offsets[i]:offsets[i + 1]]; no word crosses a border of texts, nor a
    place where ``parted`` (a flag for each byte) lets another begin.
    """
    word = ~apart[data]
    begins = np.ones(len(word), dtype=bool) if parted is None else parted.copy()
    begins[1:] = ~word[:-1] if parted is None else begins[1:] | ~word[:-1]
    begins[:1] = True
    begins[offsets[offsets < len(word)]] = True
    ends = np.ones(len(word), dtype=bool)
    ends[:-1] = begins[1:] | ~word[1:]
    starts = np.flatnonzero(word & begins)
    return starts, np.flatnonzero(word & ends) + 1, np.diff(np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Masks that keep the first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lanes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of a byte array in lanes of eight bytes (the last one filled with zeros).

    Lane values, the number of each within its span, and where each span's lanes begin.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lanes = (ends - starts + 7) >> 3
    first = np.cumsum(lanes) - lanes
    if len(lanes) and lanes.max() == 1:
        j, at, left = np.zeros(len(starts), np.int64), starts, ends - starts
    else:
        j = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        at = np.repeat(starts, lanes) + 8 * j
        left = np.repeat(ends, lanes) - at
    return eight[at] & _FIRST[np.minimum(left, 8)], j, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans (none empty) of a byte array: each lane is mixed with its number, then they are summed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    value, j, first = lanes_of(data, starts, ends)
    total = np.add.reduceat(mixed(value + mixed((j + 1).astype(np.uint64) * _STEP)), first)
    return mixed(total + (ends - starts).astype(np.uint64) * _STEP)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and its len + 1 offsets from 0; null counts as empty."""
    data, offsets = text_bytes(column)
    at = np.array(offsets, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])) if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]
