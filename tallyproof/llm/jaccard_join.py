"""N-gram Jaccard join by partitions of the universe of shingles.

Sets of word shingles link when their Jaccard similarity reaches a threshold. Equal sets
are one class. For each band of set sizes the universe of shingles is hashed into segments,
so many that a segment holds one shingle of a set: its subsets are single shingles. The
pigeonhole principle: two sets that link hold so much in common that they meet in one of
their cheapest segments. Cost is the number of sets that a segment's shingle stands in.

- A set of n shingles with r of them left from a segment on (in order of cost) can share at
  most r with a partner that it meets there first, so the partner has at most 7 r / 3 - n.
  That bound is allotted to each segment of each set. Segments whose bound lets no partner
  of the band in are not indexed; two sets meet only if each is within the other's bound.
- Sets meet the hub of a segment first (the set that comes to it after the fewest cheaper ones),
  are verified and become one component where they link. Only the sets of different
  components are then paired, within the bounds, and verified: groups of copies cost as much
  as they have members, and no link between components is lost.

A segment's one-deletion neighbourhood would let coarser segments be used, but then gains
count against the pigeonholes as well as losses: twice as many segments must be probed,
down into those that whole families share (README has the figures).

Before all that, a set with more than a quarter of its shingles in no other class is set aside: it has
no partner. A hashed part of the universe is counted, which decides for nearly all sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, mixed, picked, pieces, shared_dir, span_hashes, stored, word_spans
from .components import components

#: Links need 100 * intersection >= PERCENT * union. The bounds below are those of 75.
PERCENT = 75
#: Of 16 parts of the universe so many are counted in step 1: over a quarter, with room.
COUNTED = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct k-word shingles of each text.

    Words are parted by ASCII blanks, A-Z lower-cased. A text of fewer words has its whole
    sequence as the one shingle, a text without words none.
    """
    data, offsets = bytes_of(batch.column("text"))
    data = data + (((data >= 65) & (data <= 90)) * 32).astype(np.uint8)
    starts, ends, words = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    full = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * _ODD[j % 5] * np.uint64(2 * (j // 5) + 1)
    full = mixed(full)
    out, at = [], 0
    for n in words.tolist():
        if n >= k:
            out.append(np.unique(full[at : at + n - k + 1]))
        elif n:
            part = h[at : at + n] * _ODD[np.arange(n) % 5] * (2 * (np.arange(n) // 5) + 1).astype(np.uint64)
            out.append(mixed(np.array([part.sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(full[:0])
        at += n
    return out


def _class_of(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _classes(k: int):
    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(batch, k)
            keys = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "ca": pa.array([a for a, _ in keys], pa.int64()), "cb": pa.array([b for _, b in keys], pa.int64()),
                }
            )

    return run


def _counted(k: int):
    """The shingles of the counted part of the universe, with the class they stand in."""

    def run(batches):
        for batch in pieces(batches):
            sets = [s for s in shingle_sets(batch, k) if len(s)]
            if not sets:
                continue
            every = np.concatenate(sets)
            of = np.repeat(np.array([_class_of(s)[0] for s in sets], dtype=np.int64), [len(s) for s in sets])
            keep = (every & np.uint64(15)) < COUNTED
            yield pa.RecordBatch.from_pydict({"sh": pa.array(every[keep].view(np.int64)), "ca": pa.array(of[keep])})

    return run


def _sets(k: int):
    """The sets of the rows whose text is of the class that they were fetched for."""

    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(batch, k)
            asked = batch.column("ca").to_pylist()
            ok = [i for i, s in enumerate(sets) if _class_of(s)[0] == asked[i]]
            yield pa.RecordBatch.from_pydict(
                {
                    "ca": pa.array([asked[i] for i in ok], pa.int64()), "n": pa.array([len(sets[i]) for i in ok], pa.int64()),
                    "sh": pa.array([sets[i].view(np.int64) for i in ok], pa.list_(pa.int64())),
                }
            )

    return run


# ---- the index -------------------------------------------------------------------------


def _borders() -> list[int]:
    """Least sizes of the bands: a partner that is not larger stands in a set's own band or in the next one down."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 4 // 3 + 1)
    return out


BORDERS = _borders()


def probes(n: int, cost: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set of n shingles: signatures of the segments to probe, places in order of cost, bounds on a partner's size.

    ``sh``: those of its shingles that other sets hold too, ``cost``: by how many. The
    others are the cheapest and let nobody meet. Its own band's segments are probed while
    the bound reaches a partner there; so are those of the next band down.
    """
    order = np.lexsort((mixed(sh), cost))
    place = n - len(sh) + np.arange(len(sh))
    bound = 7 * (n - place) // 3 - n
    band, least = bisect_right(BORDERS, n) - 1, -(-3 * n // 4)
    sig, at = [], []
    for b, from_ in ((band, max(least, BORDERS[band])), (band - 1, max(least, BORDERS[band - 1]))):
        if b >= 0 and least < BORDERS[b + 1]:
            upto = int(np.searchsorted(-bound, -from_, side="right"))
            sig.append(mixed(sh[order[:upto]] ^ mixed(np.array([b + 1], dtype=np.uint64))).view(np.int64))
            at.append(np.arange(upto))
    at = np.concatenate(at)
    return np.concatenate(sig), place[at], bound[at]


PROBES = "sig long, ca long, n long, place int, bound long"


def _probes(batches):
    for batch in batches:
        ns, cas = batch.column("n").to_pylist(), batch.column("ca").to_pylist()
        lists = batch.column("held")
        ends = np.cumsum([0, *(len(x) for x in lists)])
        every = lists.flatten()
        cost, sh = every.field("cost").to_numpy(), every.field("sh").to_numpy().view(np.uint64)
        found = [probes(n, cost[a:b], sh[a:b]) for n, a, b in zip(ns, ends, ends[1:], strict=False)]
        size = [len(f[0]) for f in found]
        if sum(size):
            yield pa.RecordBatch.from_pydict(
                {
                    "sig": np.concatenate([f[0] for f in found]), "ca": np.repeat(np.array(cas, np.int64), size),
                    "n": np.repeat(np.array(ns, np.int64), size), "place": np.concatenate([f[1] for f in found]).astype(np.int32),
                    "bound": np.concatenate([f[2] for f in found]),
                }
            )


def _linked(pairs: DataFrame, sets: DataFrame, work: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity, by the exact intersection; b is the hub, if there is one.

    The sets of b are written first: a plain table is broadcast if it is small, else the rows of a widespread hub can be split.
    """
    left = sets.select(F.col("ca").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    right = sets.select(F.col("ca").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    right = stored(right.join(pairs.select("b").distinct(), "b", "left_semi"), "hub_sets", work)
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(100 * same >= PERCENT * (F.col("na") + F.col("nb") - same)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(sets: DataFrame, hub_rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) between classes that make the same components as all links between them, and the components.

    ``sets``: ca, n, sh. In each of at most ``hub_rounds`` rounds every class that meets other
    components tries one hub, the one it meets most often. They end when few classes still
    have a hub to try; the last step pairs what is left, however much that is.
    """
    spark = sets.sparkSession
    work = shared_dir(spark, "links")
    each = sets.select("ca", "n", F.explode("sh").alias("sh"))
    shared = stored(each.groupBy("sh").agg(F.count("*").alias("cost")).filter("cost > 1"), "shared", work)
    held = each.join(shared, "sh").groupBy("ca").agg(F.first("n").alias("n"), F.collect_list(F.struct("cost", "sh")).alias("held"))
    index = stored(held.filter("4 * size(held) >= 3 * n").mapInArrow(_probes, PROBES), "probes", work)
    named = index.withColumn("label", F.col("ca"))
    edges = labels = tried = None
    for r in range(hub_rounds + 1):
        if labels is not None:
            named = index.join(labels.select(F.col("node").alias("ca"), "label"), "ca", "left").withColumn("label", F.coalesce("label", "ca"))
        per = named.groupBy("sig", "label").agg(F.count("*").alias("k"), F.min(_central(r)).alias("hub")).groupBy("sig").agg(
            F.sum("k").alias("k"), F.max(F.struct("k", "label")).alias("most"), F.min("hub").alias("hub"), F.count("*").alias("labels")
        )
        meeting = stored(per.filter("labels > 1").select("sig", "k", F.col("most.k").alias("same"), F.col("most.label").alias("largest"), "hub"), "meeting", work)
        left = meeting.agg(F.sum(F.expr("k * (k - same)")).alias("w"), F.sum("k").alias("k")).first()
        if not left["k"]:
            break
        pairs = None if r == hub_rounds or (r and left["w"] <= 16 * left["k"]) else _with_hubs(named, meeting, tried, work)
        last = pairs is None or (r > 0 and 16 * pairs.count() < left["k"])
        if last:
            rows = named.join(meeting.select("sig", "largest"), "sig")
            one = rows.filter("label <> largest").select("sig", F.col("ca").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("bound").alias("ma"))
            two = named.select("sig", F.col("ca").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("bound").alias("mb"))
            met = one.join(two, "sig").filter("la <> lb and na <= mb and nb <= ma")
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = stored(pairs, "tried", work)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
        found = stored(_linked(pairs, sets, work), "found", work)
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges, within=work)
        if last:
            break
    none = spark.createDataFrame([], "u long, v long")
    out = stored(none if edges is None else edges, "edges"), stored(none.toDF("node", "label") if labels is None else labels, "labels")
    discard(spark, work)  # these two are all that is read from here on
    return out


def _with_hubs(named: DataFrame, meeting: DataFrame, tried: DataFrame | None, work: str) -> DataFrame:
    """For each class the untried hub (b) of another component that it (a) meets most often; a stored table."""
    met = named.join(meeting.select("sig", "hub"), "sig").filter("label <> hub.label and n <= hub.bound and hub.n <= bound")
    pairs = met.groupBy(F.col("ca").alias("a"), F.col("hub.ca").alias("b")).count()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return stored(pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")), "hubs", work)


def _central(r: int):
    """The order in which a segment's sets are hubs: in round 0 by their place there, then at random."""
    place = F.col("place") if r == 0 else F.lit(0)
    return F.struct(place.alias("place"), F.xxhash64(F.lit(r), "ca").alias("h"), "ca", "label", "n", "bound")


def _live(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their classes, the classes, and those that step 1 leaves."""
    table = stored(rows.mapInArrow(_classes(k), "rid long, doc_id long, n long, ca long, cb long"), "sets")
    classes = stored(table.filter("n > 0").groupBy("ca", "cb", "n").agg(F.min("doc_id").alias("rep")), "classes")
    counted = rows.mapInArrow(_counted(k), "sh long, ca long")
    of_sh = counted.groupBy("sh").agg(F.min("ca").alias("ca"), F.max("ca").alias("top")).filter("ca = top")
    alone = of_sh.groupBy("ca").agg(F.count("*").alias("alone"))
    live = classes.join(alone, "ca", "left").filter("4 * coalesce(alone, 0) <= n").select("ca", "rep")
    return table, classes, stored(live, "live")


def near_duplicates(
    docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000,
    row_key: str | None = None,
) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (least doc_id reachable by links, itself included).

    Also rid (``row_key`` of the input, a long, else null) and component, a 64-bit name of the
    component (null for a text without words). A row for each input row; repeated ids
    stay apart, each with its own text's set, and a null id never names a component that has
    another. Texts without words (null too) link with nothing. Equal sets are one class
    wherever they stand, however many; classes are told apart by 128-bit hashes, and the
    graph names them by 64 bits. The ids whose sets are fetched again are broadcast only up
    to ``broadcast_rows``; beyond, texts are shuffled.
    """
    rid = docs[row_key].cast("long") if row_key else F.lit(None).cast("long")
    rows = picked(docs, id_col, text_col, rid.alias("rid"))
    table, classes, live = _live(rows, k)
    wanted = live.select("ca", F.col("rep").alias("doc_id"))
    if live.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    same_id = rows["doc_id"].eqNullSafe(wanted["doc_id"])
    fetched = rows.join(wanted, same_id).select(rows["doc_id"], "text", "ca").mapInArrow(_sets(k), "ca long, n long, sh array<long>")
    sets = stored(fetched, "live_sets")
    if not sets.groupBy("ca").count().filter("count > 1").isEmpty():  # repeated rows of an id were fetched
        sets = stored(sets.dropDuplicates(["ca"]), "live_sets")
    _, labels = links(sets)
    named = classes.join(labels.select(F.col("node").alias("ca"), "label"), "ca", "left").withColumn("label", F.coalesce("label", "ca"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "label").select("ca", "cb", "n", "component_id", F.col("label").alias("component"))
    return table.join(of_class, ["ca", "cb", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "rid", "component",
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component: the one with the least (id, place in the table).

    Rows without words all stay. ``docs`` must be a stored table, as its rows are told apart
    by their places in it. The rows that go are broadcast up to ``broadcast_rows``.
    """
    placed = docs.withColumn("_rid", F.monotonically_increasing_id())
    found = near_duplicates(placed, id_col=id_col, text_col=text_col, row_key="_rid").filter("n_shingles > 0")
    found = stored(found.select("rid", "doc_id", "component"), "members")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f"))
    gone = found.join(first.select(F.col("f.rid").alias("rid")), "rid", "left_anti").select(F.col("rid").alias("_rid"))
    gone = stored(gone, "copies")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return placed.join(gone, "_rid", "left_anti").drop("_rid")
