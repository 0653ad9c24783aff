import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tallyproof.llm.periodic_runs import collapsed, periodic_runs, run_digest, runs_of, with_repeated_tails


def brute(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(rng, n, kinds):
    words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p = rng.randrange(n), rng.choice([1, 2, 3, 5, 8, 9, 13, 40])
            for i in range(a, min(n, a + p * rng.randrange(2, 9))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (1, 2), (6, 2), (10, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least + times)
    texts = [planted(rng, rng.choice([0, 1, 2, 23, 24, 25, 60, 200, 400]), rng.choice([1, 2, 3, 50, 1000])) for _ in range(150)]
    texts += [[b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 12, [b"a", b"b"] * 12 + [b"a"], [b"x"] + [b"a", b"b", b"a"] * 20 + [b"a"] * 30, [b"a"] * 5000]
    texts += [texts[5], texts[7]]
    found = runs_of(texts, least, times)
    for i, words in enumerate(texts):
        if len(words) < 1000:
            assert found.get(i, []) == brute(words, least, times)
    assert found[len(texts) - 3] == [(0, 5000, 1)]


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert runs_of([b], 2, 2).get(0, []) == brute(b, 2, 2)
    assert runs_of([b], 24, 3).get(0, []) == brute(b, 24, 3)


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def test_tables(spark):
    rng = random.Random(3)
    rows = [(i, b" ".join(planted(rng, rng.choice([1, 5, 40, 120, 300]), rng.choice([2, 40]))).decode(), "x") for i in range(120)]
    rows += [(120, None, "x"), (121, "", "x"), (None, "a " * 40, "x"), (122, " \t\x0b\n ", "x"), (0, "again b é " * 30, "x"), (0, "again b é " * 30, "x")]
    rows += [(500 + i, " ".join(f"é{j % 7}" for j in range(50)), "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = run_digest(periodic_runs(with_repeated_tails(docs))).collect()
    want = [expected(i, t) for i, t, _ in rows]
    assert any(r[1] > 1 for r in want) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) > 5
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert run_digest(periodic_runs(with_repeated_tails(docs.limit(0)))).count() == 0
    assert "Exchange" not in periodic_runs(docs)._jdf.queryExecution().executedPlan().toString()


def test_long_text_and_refusals(spark):
    words = [b"%d" % (i * i % 997) for i in range(30000)]
    words[5000:25000] = [words[5000 + i % 2500] for i in range(20000)]
    runs = runs_of([words])[0]
    assert (5000, 20000, 2500) in [(s, n, q) for s, n, q in runs] or any(s <= 5000 and s + n >= 25000 for s, n, q in runs)
    assert len(collapsed(words, runs)) < 30000
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), times=1)
