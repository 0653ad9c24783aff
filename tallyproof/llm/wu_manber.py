"""Benchmark decontamination: Wu-Manber multi-pattern search over word ids.

The symbols are words (those that no benchmark item holds share the id 0), a block
is up to three words. A shift table over hashed blocks tells how far a search may
skip, buckets by the hash of a pattern's last block select test strings where no skip
is allowed, and every selected string is compared word by word. Texts are searched
many at a time: each walker owns the ends in one stride, as long as the largest skip,
so that walkers are independent and numpy moves them together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, carried, kept_of, kept_schema, lanes_of, picked, pieces, span_hashes, stored, word_spans

WINDOW = 10
TABLE_BITS = 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)
#: Bytes that stand in no word: words are ASCII digits and letters, and every byte above ASCII.
_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first eight bytes and length of each word of many texts, A-Z lower-cased, and the words by text."""
    data, offsets = bytes_of(column)
    data = data + (((data >= 65) & (data <= 90)) * 32).astype(np.uint8)
    starts, ends, per_text = word_spans(data, offsets, apart=_APART)
    lanes, _, first = lanes_of(data, starts, ends)
    return span_hashes(data, starts, ends), lanes[first], ends - starts, per_text


class Matcher:
    """Patterns of one block of benchmark items, by length: numpy tables only, made once and broadcast."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.items = [i for i, _ in items]
        h, lane, size, per_item = words_of(pa.array([t for _, t in items], pa.string()))
        self.hashes, at, ids = np.unique(h, return_index=True, return_inverse=True)
        self.lanes, self.sizes = lane[at], size[at]
        ids = (ids + 1).astype(np.int32)
        ends = np.cumsum(per_item)
        self.by_length = []
        for length in np.unique(np.minimum(per_item, window)).tolist():
            if length:
                of = np.flatnonzero(np.minimum(per_item, window) == length)
                many = per_item[of] - length + 1
                begin = np.repeat(ends[of] - per_item[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
                self.by_length.append(_Tables(length, ids[begin[:, None] + np.arange(length)], np.repeat(of, many)))

    def ids(self, h: np.ndarray, lane: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words in the items' vocabulary, 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.hashes[at] == h) & (self.lanes[at] == lane) & (self.sizes[at] == size)
        return np.where(same, at + 1, 0).astype(np.int32)


class _Tables:
    """Patterns of one length; ``patterns`` may repeat, ``items`` has the item of each."""

    def __init__(self, length: int, patterns: np.ndarray, items: np.ndarray):
        self.length, self.block = length, min(3, length)
        self.stride = length - self.block + 1
        self.patterns, which = np.unique(patterns, axis=0, return_inverse=True)
        which = which.ravel()
        pairs = np.unique(np.c_[which, items], axis=0)
        self.owner_starts, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1)), pairs[:, 1].astype(np.int32)
        self.bits = min(TABLE_BITS, max(8, int(16 * len(self.patterns)).bit_length()))
        self.shift = np.full(1 << self.bits, self.stride, dtype=np.int8)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self.hashed(self.patterns, np.full(len(self.patterns), end)), length - 1 - end)
        suffix = self.hashed(self.patterns, np.full(len(self.patterns), length - 1))
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def hashed(self, rows: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at ``end``, in each row of a matrix or at places of a vector."""
        code = np.zeros(len(end), dtype=np.uint64)
        for k in range(self.block):
            word = rows[np.arange(len(end)), end - k] if rows.ndim == 2 else rows[end - k]
            code = code * np.uint64(31) + word.astype(np.uint64) * _MIX[k]
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word's place, pattern) of every occurrence in ``ids``."""
        at = np.arange(self.length - 1, len(ids), self.stride)
        limit = at + self.stride
        places, found = [], []
        while len(at):
            code = self.hashed(ids, at)
            skip = self.shift[code].astype(np.int64)
            for_test = skip == 0
            if for_test.any():
                end, code = at[for_test], code[for_test]
                first = self.starts[code]
                count = self.starts[code + 1] - first
                where = np.repeat(np.arange(len(end)), count)
                within = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
                pattern, end = self.order[first[where] + within], end[where]
                for k in range(self.length):  # direct comparison; few stay after the first word
                    same = ids[end - k] == self.patterns[pattern, self.length - 1 - k]
                    end, pattern = end[same], pattern[same]
                    if not len(end):
                        break
                places.append(end)
                found.append(pattern)
            at = at + np.maximum(skip, 1)
            stay = at < np.minimum(limit, len(ids))
            at, limit = at[stay], limit[stay]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


def _searched(matcher: Matcher, batch: pa.RecordBatch) -> tuple[list[int], list[list[int]], list[list]]:
    """Words, hit stretches (start, end, start, end ...) and items of each text."""
    h, lane, size, lengths = words_of(batch.column("text"))
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    ids = np.zeros(int(first[-1]), dtype=np.int32)  # no pattern holds id 0, so none matches across texts
    ids[np.arange(len(h)) + np.repeat(np.arange(len(lengths)), lengths)] = matcher.ids(h, lane, size)
    lengths = lengths.tolist()
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    items: list[set] = [set() for _ in lengths]
    for tables in matcher.by_length:
        ends, patterns = tables.search(ids)
        np.add.at(edge, ends - tables.length + 1, 1)
        np.add.at(edge, ends + 1, -1)
        for row, p in set(zip((np.searchsorted(first, ends, side="right") - 1).tolist(), patterns.tolist(), strict=True)):
            owners = tables.owners[tables.owner_starts[p] : tables.owner_starts[p + 1]]
            items[row].update(matcher.items[i] for i in owners.tolist())
    hit = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    rows = np.searchsorted(first, turns[::2], side="right") - 1
    stretches: list[list[int]] = [[] for _ in lengths]
    for row, start, end in zip(rows.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        stretches[row] += [start - int(first[row]), end - int(first[row])]
    return lengths, stretches, [list(x) for x in items]


def _searcher(shared):
    def run(batches):
        matcher: Matcher = shared.value
        for batch in pieces(batches):
            _, stretches, items = _searched(matcher, batch)
            old = batch.column("stretches").to_pylist(), batch.column("items").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                    "stretches": pa.array([(a or []) + b for a, b in zip(old[0], stretches, strict=True)], pa.list_(pa.int64())),
                    "items": pa.array([(a or []) + b for a, b in zip(old[1], items, strict=True)], pa.list_(pa.string())),
                    **{c: batch.column(c) for c in batch.schema.names if c.startswith("kept_")},
                }
            )

    return run


def _digester(shared, keep: tuple[str, ...], text_col: str):
    """The last (mostly the only) block of items: search and sum up, so that no text leaves the task."""

    def run(batches):
        matcher: Matcher = shared.value
        for batch in pieces(batches):
            lengths, stretches, items = _searched(matcher, batch)
            if "stretches" in batch.schema.names:
                stretches = [(a or []) + b for a, b in zip(batch.column("stretches").to_pylist(), stretches, strict=True)]
                items = [(a or []) + b for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            hits = []
            for x in stretches:
                n, reach = 0, 0
                for start, end in sorted(zip(x[::2], x[1::2], strict=True)):
                    n, reach = n + max(0, end - max(start, reach)), max(reach, end)
                hits.append(n)
            names = [sorted({str(y) for y in x}) for x in items]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(lengths, pa.int64()), "n_hit": pa.array(hits, pa.int64()),
                    "n_items": pa.array([len(x) for x in names], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    "contaminated": pa.array([n > 0 for n in hits]),
                    **kept_of(batch, keep, text_col),
                }
            )

    return run


def blocks_of(benchmark: DataFrame, block_bytes: int, item_col: str = "item_id", text_col: str = "text"):
    """Blocks of whole items of about ``block_bytes`` of text each, one at a time on the driver.

    Equal items are one before they are cut by a hash, so copies of an item fill no block. A benchmark
    below the bound (the usual case) is one block and no more than that is ever broadcast.
    """
    items = benchmark.select(
        F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item_id"), benchmark[text_col].cast("string").alias("text")
    ).filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield b == n - 1, [(r["item_id"], r["text"]) for r in part.collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Words of each text that lie in an occurrence of a benchmark window.

    Result: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and kept_<c> for each
    column c of ``keep``; a row for each row of ``docs``. A window is ``window``
    consecutive words of an item, or all words of a shorter one; items without words and
    null texts have none. Repeated items count once by item_id; those without an item_id are one item, whose name is empty. The items are broadcast in
    blocks of at most about ``block_bytes``; with more than one block the stretches found so
    far are stored with the texts between the passes, so every block sees every text.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col, *carried(docs, keep, text_col))
    kept = kept_schema(docs, keep)
    for last, items in blocks_of(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Matcher(items, window))
        if last:
            return rows.mapInArrow(
                _digester(shared, keep, text_col),
                "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + kept,
            )
        if "stretches" not in rows.columns:
            rows = rows.withColumn("stretches", F.lit(None).cast("array<long>")).withColumn("items", F.lit(None).cast("array<string>"))
        rows = stored(
            rows.mapInArrow(
                _searcher(shared),
                "doc_id long, text string, stretches array<long>, items array<string>" + kept_schema(docs, tuple(c for c in keep if c != text_col)),
            ),
            "contamination",
        )
    raise AssertionError("blocks_of yields at least one block")
