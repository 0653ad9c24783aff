import hashlib
import random
import re

import pyarrow as pa
import pytest

from tallyproof.llm.wu_manber import Matcher, _searched, contamination


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


def brute(docs, items, window=10):
    out = []
    for d in docs:
        w, hit, found = words_of((d or "").encode()), set(), set()
        for i, t in items:
            iw = words_of((t or "").encode())
            n = min(window, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add(i)
        out.append((len(w), len(hit), found))
    return out


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" for k in range(rng.choice([2, 3, 60]))]
    items = [(i, made(rng, rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]), vocabulary)) for i in range(12)]
    docs = [made(rng, rng.choice([0, 1, 5, 20, 60]), vocabulary) + " " + rng.choice(["", rng.choice(items)[1]]) for _ in range(8)] + [None]
    n, stretches, found = _searched(Matcher(items), pa.RecordBatch.from_pydict({"text": pa.array(docs, pa.string())}))
    got = [(a, sum(x[1::2]) - sum(x[::2]), set(y)) for a, x, y in zip(n, stretches, found)]
    assert got == brute(docs, items)


def test_operator_in_one_and_in_many_blocks(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(40)]
    items = [(i, made(rng, 25, vocabulary)) for i in range(20)] + [(20, None), (21, "..."), (5, made(rng, 12, vocabulary))]
    docs = [(i, items[i % 20][1] + " and " + items[(i * 7) % 20][1][5:60], 1) for i in range(30)]
    docs += [(30, None, 1), (31, "", 2), (None, items[0][1], 3), (0, docs[0][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, contamination(d, b).collect()))
    assert one == sorted(map(str, contamination(d, b, block_bytes=300).collect()))
    expected = brute([x[1] for x in docs], items)
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(d, b).collect()}
    assert got == {(x[0], n, h, len(f)) for x, (n, h, f) in zip(docs, expected)}
    assert contamination(d.limit(0), b).count() == 0
    assert not any(r["contaminated"] for r in contamination(d, b.limit(0)).collect())


def test_items_named_by_words_and_a_very_long_text(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [("b-two", made(rng, 15, vocabulary)), ("b-one", made(rng, 12, vocabulary))]
    long = "Ö " * 400_000 + items[0][1].upper() + " x" * 100_000 + " " + items[1][1]
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = contamination(d, spark.createDataFrame(items, "item_id string, text string")).first()
    assert (r["n_words"], r["n_hit"], r["n_items"]) == (500_027, 27, 2)
    assert r["items_sha256"] == hashlib.sha256(b"b-one,b-two").hexdigest()


def test_repeated_and_nameless_items(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    one, two = made(rng, 14, vocabulary), made(rng, 11, vocabulary)
    items = [("x", one)] * 300 + [(None, two), (None, two), (None, None)]
    docs = spark.createDataFrame([(1, one + " . " + two), (2, two), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for block_bytes in (1 << 20, 100):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in contamination(docs, b, block_bytes=block_bytes).collect()}
        assert got == {1: (25, 2, sha(",x")), 2: (11, 1, sha("")), 3: (0, 0, sha(""))}
