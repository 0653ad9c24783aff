"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows are dealt into parts by a hash, and the anchors go to every part, where they are a
stated query set, in blocks: no cross join, and no pair leaves a part unless it stands
in a window there. A part's index works thus:

- Dimensions are put in the order of their weight in the part, with the norm of what is left
  of each row behind every step of ``STEP`` dimensions.
- At a threshold t, a row's dimensions are posted only up to the step where the norm of its
  rest times the anchor's norm falls below t: what is omitted can't reach t by itself.
- Posted dimensions add to partial scores. A pair is dropped when its partial score plus the
  product of both remaining norms stays below t; pairs that are left are finished exactly.
- An anchor whose windows are not full gets a lower threshold; scores gathered so far stay, and only
  the dimensions that the lower threshold asks for are posted in addition.

Each part gives its first rows of each window; the first of all parts are the result, so windows are exact.
Positives come first (a join within labels), negatives next, whose windows the positives' scores bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Dimensions posted at a time.
STEP = 8
#: Anchors that a part meets at a time.
BLOCK = 64
#: A threshold that is not reached by enough rows is lowered to this part of itself.
LOWER = 0.75
_NO_ID = np.iinfo(np.int64).max


class Part:
    """The index of some rows, and the thresholds' joins with blocks of anchors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        self.vectors, self.ids, self.rids, self.labels = vectors[:, self.order], ids, rids, labels
        self.rest = _rest(self.vectors)
        self.peak = float(self.rest[:, 0].max(initial=0))

    def of(self, chosen: np.ndarray) -> Part:
        """The part's index cut to some of its rows."""
        out = object.__new__(Part)
        out.order, out.vectors, out.ids, out.rids, out.labels, out.rest = self.order, self.vectors[chosen], self.ids[chosen], self.rids[chosen], self.labels[chosen], self.rest[chosen]
        out.peak = float(out.rest[:, 0].max(initial=0))
        return out


def _rest(vectors: np.ndarray) -> np.ndarray:
    """The norm of each row's dimensions from every step on, a little enlarged; the last column is 0."""
    squares = np.square(vectors.astype(np.float64))
    steps = -(-vectors.shape[1] // STEP)
    out = np.zeros((len(vectors), steps + 1))
    for k in range(steps - 1, -1, -1):
        out[:, k] = out[:, k + 1] + squares[:, k * STEP : (k + 1) * STEP].sum(axis=1)
    return np.sqrt(out) * (1 + 1e-9)


class Join:
    """Scores of a block of anchors against a part, found down to thresholds that only fall."""

    def __init__(self, part: Part, anchors: np.ndarray):
        self.part, self.anchors = part, anchors[:, part.order]
        self.rest = _rest(self.anchors)
        top = part.peak * float(self.rest[:, 0].max(initial=0))
        #: Integers below 2^24 are exact as 4-byte floats, below 2^53 as 8-byte floats, beyond as Python's.
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
        self.exact = kind is object
        cast = (lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)) if self.exact else (lambda x: x.astype(kind))
        self.left, self.right = cast(self.anchors), cast(part.vectors)
        self.scores = np.zeros((len(anchors), len(part.vectors)), dtype=kind)
        self.posted = np.zeros(len(part.vectors), dtype=np.int64)

    def _post(self, rows: np.ndarray, k: int) -> None:
        a, b = k * STEP, (k + 1) * STEP
        if len(rows) == self.scores.shape[1]:
            self.scores += self.left[:, a:b] @ self.right[:, a:b].T
        else:
            self.scores[:, rows] += self.left[:, a:b] @ self.right[rows, a:b].T
        self.posted[rows] = k + 1

    def reaching(self, open_: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor of ``open_``, row) whose score is at least the anchor's threshold, with their exact scores."""
        steps = self.rest.shape[1] - 1
        norm = self.rest[open_, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(norm > 0, least / norm, np.where(least > 0, np.inf, -np.inf)).min(initial=np.inf)
        for k in range(steps):
            self._post(np.flatnonzero((self.posted == k) & (self.exact | (self.part.rest[:, k] >= bound))), k)
        a, r = [], []
        for depth in np.unique(self.posted).tolist():
            rows = np.flatnonzero(self.posted == depth)
            if self.exact:
                hit = self.scores[np.ix_(open_, rows)] >= least[:, None]
            else:
                reach = self.scores[np.ix_(open_, rows)] + np.outer(self.rest[open_, depth], self.part.rest[rows, depth]).astype(np.float32) * np.float32(1.0001)
                hit = reach >= least[:, None] - np.float32(0.5)
            x, y = np.nonzero(hit)
            a.append(x)
            r.append(rows[y])
        a, r = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*r, np.zeros(0, np.int64)])
        score = self.scores[open_[a], r]
        for depth in np.unique(self.posted[r]).tolist():
            if depth < steps:
                some, d = np.flatnonzero(self.posted[r] == depth), depth * STEP
                for at in range(0, len(some), 1 << 16):
                    p = some[at : at + (1 << 16)]
                    score[p] += (self.left[open_[a[p]], d:] * self.right[r[p], d:]).sum(axis=1)
        kept = score >= least[a]
        return a[kept], r[kept], score[kept]


def _first(keys: list[np.ndarray], most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each key[0], in the order of the other keys; rows come sorted by key[0]."""
    order = np.lexsort(keys[::-1])
    head = keys[0][order]
    new = np.ones(len(head), dtype=bool)
    new[1:] = head[1:] != head[:-1]
    at = np.arange(len(head))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]


def _positives(part: Part, block: dict, most: int) -> Iterator[tuple]:
    """(anchor's place in the block, id, score) of the first rows of the anchor's label in this part, without itself."""
    for label in np.unique(block["label"]).tolist():
        rows = part.of(np.flatnonzero(part.labels == label))
        here = np.flatnonzero(block["label"] == label)
        if not len(rows.ids):
            continue
        join = Join(rows, block["vectors"][here])
        left = np.arange(len(here))
        least = 0.9 * rows.peak * join.rest[:, 0]
        while len(left):
            end = least[left] < -rows.peak * join.rest[left, 0]
            asked = np.where(end, -np.inf, least[left])
            a, r, score = join.reaching(left, asked)
            other = rows.rids[r] != block["rid"][here[left[a]]]
            a, r, score = a[other], r[other], score[other]
            full = (np.bincount(a, minlength=len(left)) >= most) | end
            done = np.flatnonzero(full[a])
            a, r, score = a[done], r[done], score[done]
            chosen = _first([a, -score, rows.ids[r]], most)
            yield here[left[a[chosen]]], rows.ids[r[chosen]], score[chosen]
            left = left[~full]
            fallen = least[left] * LOWER
            least[left] = np.where(fallen > 0.1 * rows.peak * join.rest[left, 0], fallen, np.where(least[left] > 0, 0.0, -np.inf))


def _negatives(part: Part, block: dict, most: int, low: int, high: int) -> Iterator[tuple]:
    """(window, id, score) of the first rows of other labels in each window of this part; a window is one positive of one anchor."""
    anchor, score = block["window_anchor"], block["window_score"]
    join = Join(part, block["vectors"])
    if len(score) and max(-int(score.min()), int(score.max())) * max(abs(low), abs(high), 100) >= 1 << 63:
        score = score.astype(object)
    floor, roof = low * score, high * score
    waiting = np.flatnonzero((floor <= roof).astype(bool))
    least = np.full(len(block["vectors"]), -np.inf)
    np.maximum.at(least, anchor[waiting], roof[waiting].astype(np.float64) / 100 * LOWER)
    while len(waiting):
        left = np.unique(anchor[waiting])
        bottom = np.full(len(least), np.inf)
        np.minimum.at(bottom, anchor[waiting], np.floor(floor[waiting].astype(np.float64) / 100))
        asked, lowest = np.maximum(bottom, least)[left], (least <= bottom)[left]
        a, r, found = join.reaching(left, asked)
        other = part.labels[r] != block["label"][left[a]]
        a, r, found = a[other], r[other], found[other]
        order = np.argsort(a, kind="stable")
        a, r, found = a[order], r[order], found[order]
        begin, end = np.searchsorted(a, np.arange(len(left))), np.searchsorted(a, np.arange(len(left)), side="right")
        place = np.searchsorted(left, anchor[waiting])
        open_ = []
        for w, k in zip(waiting.tolist(), place.tolist()):
            s, n = found[begin[k] : end[k]], r[begin[k] : end[k]]
            whole = 100 * (s if join.exact else s.astype(np.int64))
            inside = np.flatnonzero((whole >= floor[w]) & (whole <= roof[w]))
            if len(inside) < most and not lowest[k] and 100 * asked[k] > floor[w]:
                open_.append(w)
                continue
            chosen = inside[_first([np.zeros(len(inside)), -s[inside], part.ids[n[inside]]], most)]
            yield np.full(len(chosen), w), part.ids[n[chosen]], s[chosen]
        waiting = np.array(open_, dtype=np.int64)
        least = np.where(least > 0, least * LOWER, -np.inf)


def _matrix(column: pa.Array, scale: float, width: int = 0) -> np.ndarray:
    """floor(scale * x) of lists of numbers, filled with zeros to one width; null lists are rows of zeros."""
    lists = [[] if x is None else x for x in column.to_pylist()]
    width = max(width, max(map(len, lists), default=0))
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return np.floor(scale * out)


def _joined(scale: float, most: int, low: int | None, high: int | None):
    """Reads a part's rows (kind 0), then blocks of anchors (kind 1), part after part."""

    def answers(part: Part, batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            width = part.vectors.shape[1]
            m = _matrix(some.column("vector"), scale, width)
            if m.shape[1] > width:
                m = m[:, :width]
            rid = some.column("rid").to_numpy()
            block = {"vectors": m, "rid": rid, "label": some.column("label").to_numpy()}
            if low is None:
                parts = [(rid[a], np.zeros(len(a), np.int64), i, s) for a, i, s in _positives(part, block, most)]
            else:
                scores = some.column("scores").to_pylist()
                block["window_anchor"] = np.repeat(np.arange(len(scores)), [len(x) for x in scores])
                block["window_score"] = np.array([y for x in scores for y in x], dtype=np.int64)
                k = np.array([j for x in scores for j in range(len(x))], dtype=np.int64)
                parts = [(rid[block["window_anchor"][w]], k[w], i, s) for w, i, s in _negatives(part, block, most, low, high)]
            for a, k, i, s in parts:
                whole = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {"rid": pa.array(a, pa.int64()), "window": pa.array(k, pa.int64()), "id": pa.array(i, mask=i == _NO_ID), "score": pa.array(whole, pa.int64())}
                )

    def run(batches):
        now, rows, part = None, [], None
        for batch in batches:
            number, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(1 + np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1]))).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if number[a] != now:
                    now, rows, part = number[a], [], None
                if kind[a] == 0:
                    rows.append((_matrix(some.column("vector"), scale), *(some.column(c).fill_null(_NO_ID).to_numpy() for c in ("id", "rid", "label"))))
                elif rows:
                    if part is None:
                        width = max(m.shape[1] for m, *_ in rows)
                        vectors = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m, *_ in rows])
                        part = Part(vectors, *(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3)))
                    yield from answers(part, some)

    return run


def _met(rows: DataFrame, anchors: DataFrame, parts: int, scale: float, most: int, low: int | None, high: int | None) -> DataFrame:
    """What every part of the rows answers to the anchors: rid, window, id, score."""
    none = F.lit(None).cast("array<long>")
    mine = rows.select(F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "rid", "id", "label", "vector", none.alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "rid", "id", "label", "vector", "scores")
    dealt = mine.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(_joined(scale, most, low, high), "rid long, window long, id long, score long")


def _leading(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each window of each anchor over all parts, numbered from 1."""
    order = Window.partitionBy("rid", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    rows_a_part: int = 1 << 16, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """The hardest rows of other labels below each of the first rows of an anchor's own label.

    Components become floor(scale * x); a score is the inner product with the anchor; higher
    scores come first, ties by the lesser id (null ids last). Rows that ``anchor`` (a condition
    on the id, as ``id``) holds for are anchors. For each of an anchor's first ``positives`` other rows of its label,
    the first ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or any null or non-finite component take no part. Shorter
    vectors count as filled with zeros. Repeated rows and repeated ids are rows of their own. Scores
    beyond 64 bits count as the nearest long. An empty table gives an empty one.

    A task holds ``rows_a_part`` rows and one block of anchors. Anchors are copied to all parts,
    and a part returns at most ``positives`` * ``negatives`` rows an anchor. Parts are equal in size whatever labels or
    copies the rows have. Two shuffles of the rows, two of the windows.
    """
    spark = vectors.sparkSession
    v = vectors[vector_col]
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = vectors.filter(vectors[label_col].isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("rid"), vectors[id_col].try_cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), v.alias("vector")
    )
    rows = stored(picked, "vectors", shared_dir(spark, "hard_negatives"))
    parts = max(-(-rows.count() // rows_a_part), 2 * spark.sparkContext.defaultParallelism)
    asking = rows.filter(anchor)
    none = F.lit(None).cast("array<long>")
    first = _leading(_met(rows, asking.withColumn("scores", none), parts, scale, positives, None, None), positives)
    chosen = first.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("found"))
    chosen = stored(chosen, "positives", shared_dir(spark, "hard_negatives"))
    again = asking.join(chosen, "rid").withColumn("scores", F.transform("found", lambda x: x["positive_score"]))
    last = _leading(_met(rows, again, parts, scale, negatives, low, high), negatives)
    ids = asking.select("rid", F.col("id").alias("anchor_id"))
    named = chosen.join(ids, "rid").select("rid", "anchor_id", F.posexplode("found").alias("window", "positive")).withColumn("window", F.col("window").cast("long"))
    return last.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["rid", "window"]).select(
        "anchor_id", "positive.positive_id", "rank", "negative_id", "positive.positive_score", "negative_score"
    )
