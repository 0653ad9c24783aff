import random
import re

import pytest

from tallyproof.llm.components import components
from tallyproof.llm.jaccard_join import near_duplicates


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(3000)}é"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            t = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 70, 150]))]
            if rng.random() < 0.4:
                cut = rng.randrange(len(t) + 1)
                t = t[:cut] + passage + t[cut:]
        else:  # copies, near copies of copies, joined and cut ones
            t = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(t) // 40, len(t) // 20])):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.choice([0, 1, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1]))]
            if rng.random() < 0.2:
                t = t[: int(len(t) * rng.uniform(0.7, 1))]
        texts.append(t)
    rows = [(i * 3 + 1, "  ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "all alone"), (rows[1][0], rows[1][1]), (rows[2][0], rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = [tuple(r)[:3] for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_no_rows_and_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in near_duplicates(docs, broadcast_rows=0).collect()) == [(1, 2, 1), (2, 1, 2)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and got[2001] == 2000


def test_a_large_family_and_a_very_long_text(spark):
    """1,500 copies, each with one word of its own, beside as many that share a passage too short to link, and a long pair."""
    rng = random.Random(8)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(20)]
    rows = []
    for i in range(1500):
        t = base[:]
        t[rng.randrange(60)] = f"own{i}"
        rows.append((2 * i + 2, " ".join(t)))
        rows.append((2 * i + 3, " ".join([f"c{i}_{j}" for j in range(40)] + passage)))
    long = [f"l{i % 90_000}x{i % 7}" for i in range(200_000)]
    rows += [(7001, " ".join(long)), (7000, " ".join(long[:190_000]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    # One changed word costs five shingles of 56; two sets share 46 of 66 unless the words are near the ends or each other.
    sets = {d: sets_of(t) for d, t in rows if d < 7000 and d % 2 == 0}
    holes = {}
    for d, t in rows:
        if d < 7000 and d % 2 == 0:
            holes.setdefault(next(i for i, w in enumerate(t.split()) if w.startswith("own")), []).append(d)
    first = {h: ds[0] for h, ds in holes.items()}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for h, ds in holes.items():  # members with the same word changed are alike to all others
        for g, e in first.items():
            if 100 * len(sets[ds[-1]] & sets[e]) >= 75 * len(sets[ds[-1]] | sets[e]):
                for d in (ds if g != h or len(ds) > 1 else ds[:1]):
                    a, b = sorted((find(d), find(e)))
                    parent[b] = a
    assert all(got[d] == find(d) for d in sets)
    assert all(got[d] == d for d, _ in rows if d < 7000 and d % 2)
    assert got[7001] == got[7000] == 7000
