"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of words with smallest period q that is at least ``least`` words and
``times`` periods long and that no neighbouring word extends. All texts of a batch share one
suffix array, whose suffixes are told apart by their text, so no prefix crosses a border.

- Suffixes are ranked by prefix doubling; only those not yet alone are sorted again, and
  the ranks of each doubling are kept: they answer how far two places agree, either way.
- Each LCP interval [lb, rb] of depth d is found by range minima of the LCP array, without
  nodes. The suffixes i of all its children but the largest are tested: i + d or i - d
  lies in the interval (by the inverse suffix array) and the words behind the two copies
  differ. That is a branching tandem repeat, the last square of a run of period d; one of its
  two suffixes always stands outside the largest child, so none is missed.
- The square is rotated to the left as far as words agree, which gives the run's first word.
  Squares with a repeated root reach the same two ends and merge into the smallest period.

A run's first suffix agrees with the one a period later on at least ``least`` - q and
(``times`` - 1) q words, so a text whose suffixes are all alone at the smaller doubling below
that has none; nearly all texts end there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, pieces, text_bytes

RUN = "struct<start: bigint, length: bigint, period: bigint>"


class _Suffixes:
    """Ranks of the suffixes of many texts, doubled step by step."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """``words``: numbers from 0, other ones in each text; ``begins``, ``ends``: the borders of each place's text."""
        self.words, self.begins, self.ends = words, begins, ends
        counts = np.bincount(words)
        self.rank = (np.cumsum(counts) - counts)[words].astype(np.int32 if len(words) < 1 << 31 else np.int64)
        self.shared = np.flatnonzero(counts[words] > 1)
        self.reach = 1

    def double(self) -> None:
        """Ranks by twice as many words; a text's end is less than any word."""
        u, n = self.shared, np.int64(len(self.words))
        ahead = u + self.reach
        second = np.where(ahead < self.ends[u], self.rank[np.minimum(ahead, n - 1)], -1)
        key = self.rank[u] * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        u, key = u[order], key[order]
        at = np.arange(len(u))
        old = self.rank[u]
        changed = np.ones(len(u), dtype=bool)
        changed[1:] = old[1:] != old[:-1]
        place = old + at - np.maximum.accumulate(np.where(changed, at, 0))
        changed[1:] = key[1:] != key[:-1]
        self.rank = self.rank.copy()
        self.rank[u] = place[np.maximum.accumulate(np.where(changed, at, 0))]
        alone = changed.copy()
        alone[:-1] &= changed[1:]
        self.shared = u[~alone]
        self.reach *= 2


def _agreeing(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b on; both lie in one text."""
    same = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        inside = np.flatnonzero((x < ends) & (y < ends))
        equal = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        same[equal] += 1 << k
    return same


def _bounds(lcp: np.ndarray, k: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """The LCP interval [lb, rb] around each place k of the LCP array, at the depth that stands there."""
    minima = [lcp]
    while (1 << len(minima)) <= widest:
        half, low = 1 << (len(minima) - 1), minima[-1]
        if len(low) <= half:
            break
        minima.append(np.minimum(low[:-half], low[half:]))
    depth, right, left = lcp[k], k + 1, k.copy()
    for j in range(len(minima) - 1, -1, -1):
        low = minima[j]
        ok = (right < len(low)) & (low[np.minimum(right, len(low) - 1)] >= depth)
        right = right + (ok << j)
        before = left - (1 << j)
        ok = (before >= 0) & (low[np.clip(before, 0, len(low) - 1)] >= depth)
        left = np.where(ok, before, left)
    return left - 1, right - 1


def _outside_largest(lcp: np.ndarray, k: np.ndarray, widest: int) -> tuple[np.ndarray, ...]:
    """For all LCP intervals that hold a place of ``k``: depth, lb, rb and a place in the suffix array, for each suffix outside the largest child."""
    lb, rb = _bounds(lcp, k, widest)
    order = np.lexsort((k, lcp[k], lb))
    k, lb, rb = k[order], lb[order], rb[order]
    depth = lcp[k]
    first = np.ones(len(k), dtype=bool)
    first[1:] = (lb[1:] != lb[:-1]) | (depth[1:] != depth[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(k))
    starts = np.insert(k, heads, lb[heads])
    ends = np.insert(k, tails, rb[heads] + 1)
    group = np.repeat(np.arange(len(heads)), tails - heads + 1)
    size = ends - starts
    child = heads + np.arange(len(heads))
    largest = np.maximum.reduceat(size, child)[group]
    at = np.arange(len(size))
    kept = np.minimum.reduceat(np.where(size == largest, at, len(size)), child)[group]
    small = np.flatnonzero(at != kept)
    of = np.repeat(small, size[small])
    done = np.cumsum(size[small]) - size[small]
    suffix = starts[of] + np.arange(len(of)) - np.repeat(done, size[small])
    g = heads[group[of]]
    return depth[g], lb[g], rb[g], suffix


def _runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period; places as in ``words``."""
    s = _Suffixes(words, begins, ends)
    levels = [s.rank]
    while len(s.shared):
        s.double()
        levels.append(s.rank)
    isa = levels.pop() if len(levels) > 1 else levels[0]
    sa = np.empty(len(isa), dtype=np.int64)
    sa[isa] = np.arange(len(isa))
    lcp = np.zeros(len(sa), dtype=np.int64)
    near = 1 + np.flatnonzero(words[sa[1:]] == words[sa[:-1]])
    lcp[near] = _agreeing(levels, sa[near - 1], sa[near], ends[sa[near]])
    long = ends - begins
    k = near[times * lcp[near] <= long[sa[near]]]
    if not len(k):
        return np.zeros((0, 3), dtype=np.int64)
    d, lb, rb, at = _outside_largest(lcp, k, int(long.max()))
    i = sa[at]
    squares = []
    for one, other in ((i, i + d), (i - d, i)):
        inside = np.flatnonzero((one >= begins[i]) & (other < ends[i]))
        moved = isa[other[inside]] if one is i else isa[one[inside]]
        inside = inside[(moved >= lb[inside]) & (moved <= rb[inside])]
        start, period = one[inside], d[inside]
        after = start + 2 * period
        last = after == ends[start]
        last |= words[start + period] != words[np.where(last, start, after)]
        squares.append(np.stack([start[last], period[last]], axis=1))
    found = np.unique(np.concatenate(squares), axis=0)
    start, period = found[:, 0].copy(), found[:, 1]
    end, begin = start + 2 * period, begins[found[:, 0]]
    for j in range(len(levels) - 1, -1, -1):
        before = start - (1 << j)
        ok = np.flatnonzero(before >= begin)
        ok = ok[levels[j][before[ok]] == levels[j][before[ok] + period[ok]]]
        start[ok] = before[ok]
    length = end - start
    rows = np.stack([start, end, period], axis=1)[(length >= least) & (length >= times * period)]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    merged = np.ones(len(rows), dtype=bool)
    merged[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[merged]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers that no two texts share, and the texts' len + 1 offsets."""
    out, used = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, used + len(seen)) for w in words), dtype=np.int64, count=len(words)))
        used += len(seen)
    return np.concatenate([*out, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, texts)])


def runs_of(texts: list[list[bytes]], least: int = 24, times: int = 3) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has some, by start, then period; starts are word numbers from 0."""
    words, offsets = _numbered(texts)
    if not len(words):
        return {}
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(texts)), sizes)
    s = _Suffixes(words, offsets[of], offsets[of + 1])
    agree = min(max(least - q, (times - 1) * q) for q in range(1, max(2, least + 1)))
    while 2 * s.reach <= agree and len(s.shared):
        s.double()
    some = np.unique(of[s.shared])
    if not len(some):
        return {}
    kept = np.zeros(len(texts), dtype=bool)
    kept[some] = True
    at = np.flatnonzero(kept[of])
    short = np.concatenate([[0], np.cumsum(sizes[some])])
    where = np.repeat(np.arange(len(some)), sizes[some])
    _, numbers = np.unique(words[at], return_inverse=True)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, end, period in _runs(numbers, short[where], short[where + 1], least, times).tolist():
        k = int(where[start])
        found.setdefault(int(some[k]), []).append((start - int(short[k]), end - start, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every whole text and what is left without their repeats.

    doc_id, runs array<struct<start, length, period>> by start, then period (word numbers from
    0, words ``[^\\x20\\x09-\\x0D]+``), collapsed string: words that no run holds after its first
    period, joined by one blank. ``least`` words and ``times`` periods (2 or more) make a run.
    Null and empty texts have no runs and collapse to nothing; a row for each input row, repeated
    ids stay apart; an empty table stays empty. One pass, no shuffle: a text is never split,
    as a run may span all of it, and takes time in proportion to n log n.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and a word")

    def run(batches):
        for batch in pieces(batches, most=2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            texts = [bytes(data[a:b]).split() for a, b in zip(offsets, offsets[1:])]
            found = runs_of(texts, least, times)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, [])] for i in range(len(texts))]
            left = [b" ".join(collapsed(w, found[i]) if i in found else w).decode() for i, w in enumerate(texts)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "runs": pa.array(runs, kind), "collapsed": pa.array(left, pa.string())})

    return picked(docs, id_col, text_col).mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def with_repeated_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth text by the id's crc32 ends in a repeated stretch of its own words.

    h is the crc32 of the id as text and g = floor(h / 10). Where h % 10 = 0 and the text has n > 0
    words, word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8));
    words are then parted by one blank. All other texts, and rows without an id, stay as they are.
    """
    rows = picked(docs, id_col, text_col)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = F.expr("transform(sequence(0L, n - 1), i -> words[int(if(i < a, i, a + (i - a) % p))])")
    chosen = rows.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long"))
    placed = chosen.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Digests of a table of periodic_runs: counts, the run of greatest exponent, and two hashes.

    The greatest exact length / period wins, then the smallest start, then the smallest period;
    start, length, period and exponent_milli are null without runs.
    """
    larger = lambda a, b: F.when(
        (b["length"] * a["period"] > a["length"] * b["period"]), b
    ).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), larger)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
