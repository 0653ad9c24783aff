"""Byte-level BPE encoding and decoding by padded numpy matrices.

Texts are cut by the pattern; the distinct pieces of a batch that the worker has not met
are put in matrices by length, one row a piece, one column a byte. In each round every
row merges its leftmost pair of the lowest rank: pairs are looked up in a hash table by
vector operations, rows are compacted, and rows without a pair to merge are done.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, picked, pieces

_NONE = np.int32(2**31 - 1)
#: Bytes of a piece from which a matrix row would cost too much; such pieces go through a heap.
LONG = 2048


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; every byte must be among them."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class PairTable:
    """Open hashing of (left id, right id) to the id of the joined token, looked up by vectors."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens) if t}
        left, right, joined = [], [], []
        for token, i in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        todo, slot, values = keys, self._slot(keys), np.array(joined, dtype=np.int32)
        self.steps = 0
        while len(todo):  # each round fills the free slots, one key each; the rest go one further
            self.steps += 1
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = todo[put], values[put]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, slot, values = todo[rest], (slot[rest] + 1) & self.mask, values[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each joined pair; a very large number where there is none."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] != np.iinfo(np.uint64).max))
        at = slot[open_]
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            stay = ~hit & (found != np.iinfo(np.uint64).max)
            open_, at = open_[stay], at[stay]
        return out.reshape(left.shape)


class ByteBpe:
    """Encodes pieces of text by ranks and decodes ids."""

    def __init__(self, path: str, pattern: str, cache: int = 100_000, cells: int = 1 << 19):
        self.tokens = read_ranks(path)
        self.pairs = PairTable(self.tokens)
        self.rank_of = {t: i for i, t in enumerate(self.tokens) if t}
        self.cut = regex.compile(pattern).findall
        single = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.of_byte = np.array([single[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cache: dict[str, bytes] = {}
        self.most, self.cells = cache, cells

    def _merge(self, rows: np.ndarray) -> list[bytes]:
        """The ids of each row (bytes of one length) as little-endian 32-bit integers."""
        n, width = rows.shape
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        ids[:, :width] = self.of_byte[rows]
        length = np.full(n, width)
        rank = np.full((n, width), _NONE, dtype=np.int32)
        if width > 1:
            rank[:, : width - 1] = self.pairs.look_up(ids[:, : width - 1], ids[:, 1:width])
        out: list[bytes] = [b""] * n
        number = np.arange(n)
        while len(number):
            best = rank.argmin(axis=1)  # the first of equal ranks is the leftmost
            row = np.arange(len(number))
            joined = rank[row, best]
            over = joined == _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    out[number[i]] = ids[i, : length[i]].astype("<u4").tobytes()
                stay = ~over
                ids, rank, length, number = ids[stay], rank[stay], length[stay], number[stay]
                best, joined, row = best[stay], joined[stay], np.arange(len(number))
                if not len(number):
                    break
            ids[row, best] = joined
            # Compaction: what is right of the merged pair moves one place to the left.
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns[None, :] > best[:, None])
            ids = np.concatenate([np.take_along_axis(ids, source, axis=1), np.full((len(number), 1), -1, np.int32)], axis=1)
            source = np.minimum(source[:, : rank.shape[1]], rank.shape[1] - 1)
            rank = np.take_along_axis(rank, source, axis=1)
            length = length - 1
            rank[row, length - 1] = _NONE
            widest = int(length.max())
            ids, rank = ids[:, : widest + 1], rank[:, :widest]
            for side, place in ((0, best - 1), (1, best)):  # only the pairs beside the merged token are new
                ok = np.flatnonzero((place >= 0) & (place < length - 1))
                rank[ok, place[ok]] = self.pairs.look_up(ids[ok, place[ok]], ids[ok, place[ok] + 1])
        return out

    def learn(self, words) -> None:
        """Encodes the distinct ``words`` that the cache lacks, by matrices of one length each."""
        known = self.cache
        new = [w for w in words if w not in known]
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = w.encode()
            by_length.setdefault(len(b), []).append((w, b))
        for length, group in by_length.items():
            at_once = max(1, self.cells // length)
            for i in range(0, len(group), at_once):
                part = group[i : i + at_once]
                if length > LONG:  # its rounds would be as many as its bytes, each as wide
                    for w, b in part:
                        known[w] = self.long_piece(b)
                    continue
                rows = np.frombuffer(b"".join(b for _, b in part), dtype=np.uint8).reshape(len(part), length)
                known.update(zip((w for w, _ in part), self._merge(rows), strict=True))

    def long_piece(self, piece: bytes) -> bytes:
        """One very long piece: a heap of (rank, place) over a linked list, n log n in its length."""
        rank_of, tokens = self.rank_of, self.tokens
        ids: list[int] = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        end = len(ids)

        def rank(i: int) -> int | None:
            return rank_of.get(tokens[ids[i]] + tokens[ids[after[i]]]) if i >= 0 and after[i] < end else None

        heap = [(r, i) for i in range(end) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:  # one side has been merged since
                continue
            gone = after[i]
            ids[i], after[i], ids[gone] = r, after[gone], -1
            if after[i] < end:
                before[after[i]] = i
            for j in (before[i], i):
                if (x := rank(j)) is not None:
                    heapq.heappush(heap, (x, j))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        distinct = set().union(*cut)
        if len(self.cache) + len(distinct) > self.most:
            self.cache.clear()
        self.learn(distinct)
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        if len(self.cache) > self.most:
            self.cache.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_MADE: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder a worker process; its cache lives as long as the worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(path, pattern)
    return _MADE[path, pattern]


def encoded(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit). Null and empty texts have no ids."""

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "ids": pa.array(bpe.encode(code_points(batch)), pa.binary())}
            )

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decoded(coded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and bytes of a table with the columns doc_id and ids; null ids give null."""

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            made = [None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(made, pa.binary())})

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns both as digests.

    doc_id, n_tokens long, ids_sha256, decoded_sha256 (lowercase hex); a row for each input
    row, repeated ids stay apart. Null counts as empty: no ids. One pass, no shuffle.
    Pieces of over LONG bytes are merged by a heap instead of a matrix row, to the same ids.
    """

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in pieces(batches):
            ids = bpe.encode(code_points(batch))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                }
            )

    return (
        picked(docs, id_col, text_col)
        .select("doc_id", F.col("text"))
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    )
