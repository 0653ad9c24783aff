"""Token-id output: Re-Pair grammar compression with random access.

Texts are encoded in ascending doc_id order and written as blocks. A block holds the ids
of whole documents as a grammar: rules (nonterminal -> pair), the expansion length of
every nonterminal, and the start sequence. Rules are found by Re-Pair rounds over the block: the
pairs that occur most often are replaced at once (those of one round share no occurrence),
until no pair is frequent enough. Any range of ids is decoded by expanding only the
symbols that cover it.
"""

from __future__ import annotations

import zlib
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, lanes_of, picked, pieces, shared_dir, span_hashes, word_spans

BLOCK_SCHEMA = (
    "shard int, block int, doc_ids array<long>, counts array<long>, n_ids long, base int, rules binary, lengths binary, symbols binary"
)


# ---- the grammar -----------------------------------------------------------------------


def _slots(left: np.ndarray, right: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """Hashes of pairs, another function each turn."""
    h = ((left * np.uint32(0x9E3779B1 + 2 * turn)) ^ (right * np.uint32(0x85EBCA6B + 4 * turn))) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def re_pair(ids: np.ndarray, base: int, *, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(rules as k x 2, start sequence). Symbol base + i expands to rules[i].

    Rounds run until no pair stands ``least`` times or more. A round counts pairs in a table
    of hashed pairs, lets one pair of each slot of ``least`` or more stand for it, and replaces
    that pair's occurrences from left to right if they are frequent. The hash differs from
    round to round, so that pairs which share a slot get their turn. All occurrences of a pair come into being in one
    round; where a slot's count is below ``least``, its pairs are never looked at again.
    """
    seq = ids.astype(np.uint32)
    found: list[np.ndarray] = []
    n_rules, turn = 0, 0
    open_ = np.ones(len(seq), dtype=bool)  # pairs that begin here may be frequent
    open_[-1:] = False
    while True:
        place = np.flatnonzero(open_)
        if len(place) < least:
            break
        left, right = seq[place], seq[place + 1]
        bits = max(10, min(20, len(place).bit_length() + 1))
        slot = _slots(left, right, turn, bits)
        turn += 1
        counts = np.bincount(slot, minlength=1 << bits)
        full = counts[slot] >= least
        open_[place[~full]] = False
        place, left, right, slot = place[full], left[full], right[full], slot[full]
        if not len(place):
            break
        stands = np.empty(1 << bits, dtype=np.int32)
        stands[slot] = np.arange(len(slot), dtype=np.int32)
        rule = stands[slot]
        same = (left == left[rule]) & (right == right[rule])
        often = np.bincount(rule[same], minlength=len(slot)) >= least
        take = same & often[rule]
        open_[place[same & ~often[rule]]] = False  # counted exactly, and rare
        at, rule = place[take], rule[take]
        if not len(at):
            continue
        # Occurrences that overlap stand next to each other: in each run of them take every other one.
        new_run = np.concatenate([[True], np.diff(at) != 1])
        first = at[new_run][np.cumsum(new_run) - 1]
        chosen = (at - first) % 2 == 0
        at, rule = at[chosen], rule[chosen]
        which = np.flatnonzero(np.bincount(rule, minlength=len(slot)))
        number = np.zeros(len(slot), dtype=np.uint32)
        number[which] = np.arange(len(which), dtype=np.uint32)
        found.append(np.stack([left[which], right[which]], axis=1))
        seq[at] = np.uint32(base + n_rules) + number[rule]
        n_rules += len(which)
        open_[at] = True
        open_[at[at > 0] - 1] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, open_ = seq[keep], open_[keep]
        open_[-1:] = False
    return np.concatenate([np.zeros((0, 2), dtype=np.uint32), *found]), seq


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal expands to. A rule's parts stand before it."""
    out = np.ones(len(rules), dtype=np.int64)
    known = 0
    while known < len(rules):  # all rules whose parts are known, together
        ready = known + int((np.cumsum((rules[known:] >= base + known).any(axis=1)) == 0).sum())
        for side in (0, 1):
            part = rules[known:ready, side].astype(np.int64) - base
            size = np.where(part < 0, 1, out[np.maximum(part, 0)])
            out[known:ready] = size if side == 0 else out[known:ready] + size
        known = ready
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, size: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols stand for. ``size``: the rules' lengths, if they are known.

    Every symbol goes straight to its place, so the work is that of the ids and rules met, however deep the grammar is.
    """
    size = lengths(rules, base) if size is None else size
    seq = symbols.astype(np.int64)
    width = _widths(seq, size, base)
    place = np.cumsum(width) - width
    out = np.empty(int(width.sum()), dtype=np.uint32)
    while len(seq):
        inner = seq >= base
        out[place[~inner]] = seq[~inner]
        pair, place = rules[seq[inner] - base].astype(np.int64), place[inner]
        place = np.concatenate([place, place + _widths(pair[:, 0], size, base)])
        seq = np.concatenate([pair[:, 0], pair[:, 1]])
    return out


def _widths(symbols: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    if not len(size):
        return np.ones(len(symbols), dtype=np.int64)
    return np.where(symbols < base, 1, size[np.maximum(symbols - base, 0)])


def decode_range(
    rules: np.ndarray, symbols: np.ndarray, base: int, start: int, stop: int, size: np.ndarray | None = None
) -> np.ndarray:
    """Ids start to stop of a block, by expanding no more than the symbols and parts of symbols that cover them.

    ``size``: the block's stored lengths; without them they are computed from the rules.
    """
    size = lengths(rules, base) if size is None else size
    ends = np.cumsum(_widths(symbols.astype(np.int64), size, base))
    start, stop = max(start, 0), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))

    def edge(i: int) -> np.ndarray:
        """The largest parts of the i-th symbol that lie in the range, in order."""
        kept, todo = [], [(int(symbols[i]), int(ends[i - 1]) if i else 0)]
        while todo:
            x, at = todo.pop()
            n = int(size[x - base]) if x >= base else 1
            if at >= stop or at + n <= start:
                continue
            if start <= at and at + n <= stop:
                kept.append(x)
                continue
            left, right = (int(y) for y in rules[x - base])
            todo += [(right, at + (int(size[left - base]) if left >= base else 1)), (left, at)]
        return np.array(kept, dtype=np.int64)

    parts = [edge(a)] if a == b else [edge(a), symbols[a + 1 : b].astype(np.int64), edge(b)]
    return expand(np.concatenate(parts), rules, base, size)


# ---- encoding --------------------------------------------------------------------------


#: ASCII signs but the apostrophe.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct content, and the content of each span: by hash, then compared byte by byte."""
    which, kinds = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(kinds), dtype=np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    value, j, at = lanes_of(data, starts, ends)
    like, size = first[which], ends - starts
    if np.array_equal(size, size[like]) and np.array_equal(value, value[np.repeat(at[like], (size + 7) >> 3) + j]):
        return first, which
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(data[a:b].tobytes(), len(place)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct blank-separated chunk once.

    For tokenizers that drop blanks, lower-case, cut between letters and other signs and end
    every word by a token with ``</w>``, as word_bpe_49k.json does. Then the ids of a text
    are those of its chunks in a row, cut between letters and signs too; and words of letters
    alone may be encoded as one line and cut after their last tokens.
    """

    def __init__(self, path: str, cache: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same merges without the steps that leave a-z as they are
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.most = cache

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _lines(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of words of letters, many words a call."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(part):  # some letter falls apart when it is lower-cased
                out += self._encoded(part)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def learn(self, chunks: list[bytes]) -> None:
        words = [c.decode() for c in chunks]
        kind = [(w.isascii() and w.islower()) + w.isalpha() if w.isalpha() else 0 for w in words]
        for k, encode in (  # 2: a-z alone; 1: letters; 0: anything
            (2, lambda x: self._lines(x, self.plain)), (1, lambda x: self._lines(x, self.tokenizer)), (0, self._encoded)
        ):
            chosen = [x == k for x in kind]
            self.known.update(zip(compress(chunks, chosen), encode(list(compress(words, chosen))), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and the ids by text.

        Text i is data[offsets[i]:offsets[i + 1]] in UTF-8. Each distinct chunk is looked up or
        encoded once, and the rest is a gather.
        """
        # A-Z may be lower-cased first where neither a special token nor a combining sign (U+0300 on) can stand.
        odd = np.searchsorted(offsets, np.flatnonzero((data == 0x3C) | (data == 0xCC) | (data == 0xCD)), side="right") - 1
        as_is = np.zeros(len(offsets) - 1, dtype=bool)
        as_is[odd] = True
        upper = (data >= 65) & (data <= 90)
        if len(odd):
            upper &= ~np.repeat(as_is, np.diff(offsets))
        data = data + (upper * 32).astype(np.uint8)
        # Letters and signs (no apostrophe, which may begin an ending like 's) always fall into different words.
        letter, sign = (data >= 97) & (data <= 122), _SIGN[data]
        parted = np.zeros(len(data), dtype=bool)
        parted[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        if len(odd):
            parted &= ~np.repeat(as_is, np.diff(offsets))
        starts, ends, per_text = word_spans(data, offsets, parted)
        raw = data.tobytes()
        first, which = alike(data, starts, ends)
        distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) + len(distinct) > self.most:
            self.known.clear()
        self.learn([c for c in distinct if c not in self.known])
        values = [*map(self.known.__getitem__, distinct), np.array([end_id], dtype="<u4").tobytes()]
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) >> 2
        place = np.cumsum(size) - size
        table = np.frombuffer(b"".join(values), dtype="<u4")
        row = np.insert(which, np.cumsum(per_text), len(distinct))
        width = size[row]
        upto = np.cumsum(width)
        ids = table[np.repeat(place[row] - (upto - width), width) + np.arange(int(upto[-1]) if len(upto) else 0)]
        closed = upto[np.cumsum(per_text + 1) - 1]
        return ids, np.diff(closed, prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _writer(vocabulary: str, end_id: int, block_ids: int):
    def run(batches):
        encoder = word_encoder(vocabulary)
        base, shard, block = max(encoder.size, end_id + 1), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def made() -> pa.RecordBatch:
            rules, symbols = re_pair(np.concatenate(held), base)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
                    "n_ids": pa.array([total], pa.int64()), "base": pa.array([base], pa.int32()),
                    "rules": pa.array([rules.astype("<u4").tobytes()], pa.binary()),
                    "lengths": pa.array([lengths(rules, base).astype("<u4").tobytes()], pa.binary()),
                    "symbols": pa.array([_packed(symbols)], pa.binary()),
                }
            )

        for batch in pieces(batches, most=4 << 20):
            ids, sizes = encoder.encode(*bytes_of(batch.column("text")), end_id)
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                docs.append(doc)
                counts.append(n)
                held.append(ids[at : at + n])
                at, total = at + n, total + n
                if total >= block_ids:
                    yield made()
                    block, docs, counts, held, total = block + 1, [], [], [], 0
        if docs:
            yield made()

    return run


def _packed(symbols: np.ndarray) -> bytes:
    """Symbols of 17 bits or so as their low 16 bits and the rest, which compresses well."""
    low = (symbols & 0xFFFF).astype("<u2").tobytes()
    high = (symbols >> 16).astype("u1").tobytes()
    return len(symbols).to_bytes(4, "little") + low + zlib.compress(high, 1)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, dtype="<u2", count=n, offset=4)
    high = np.frombuffer(zlib.decompress(data[4 + 2 * n :]), dtype="u1")
    return low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))


def write_grammar(
    docs: DataFrame, vocabulary: str, *, end_id: int = 2, block_ids: int = 1 << 20, partition_bytes: int = 32 << 20,
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """Encode all texts, append ``end_id`` to each, and write the ids as grammar blocks under ``path``.

    Rows go in ascending (doc_id, text) order, null ids first: shard s of the table holds
    the s-th range of ids, its blocks follow each other. A shard covers about
    ``partition_bytes`` of text, a block about ``block_ids`` ids or one longer document. Null
    texts count as empty and hold the end id alone. Returns the written table.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # A range border may not fall inside equal ids; the text's checksum orders repeats of one id.
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(int(total // partition_bytes) + 1, F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
    )
    path = path or shared_dir(spark, "grammar")
    ordered.mapInArrow(_writer(vocabulary, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Adds start: the ids of all blocks before. Sums run over shards (one row each), then inside each shard."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within"))
        .join(firsts, "shard")
        .select("shard", "block", (F.col("first") + F.col("within")).alias("start"))
    )
    return blocks.join(places, ["shard", "block"])


def read_back(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the written blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, size = unpacked(row["symbols"]), np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
                ids = expand(symbols, np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), row["base"], size).astype("<u4")
                raw, counts = memoryview(ids.tobytes()), np.array(row["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(row["start"] + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "n_symbols": pa.array(list(repeat(len(symbols), len(crc))), pa.int64()),
                    }
                )

    return with_starts(blocks).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long"
    )

