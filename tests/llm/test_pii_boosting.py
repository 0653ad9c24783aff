import hashlib
import random
import re

from tallyproof.llm.pii_boosting import KINDS, find_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(BASE[k], text or "") if fits(k, m[0])] for k in KINDS}
    return found, ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def texts():
    rng = random.Random(3)
    parts = ["a@b.c", "a@b.c_d@e.f", "x..%@q-.1.2.", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "1.2.3.4", "0001.2.3.255.7", "300.1.1.1",
             "+1 (555) 123-4567", "+12", "+1-2", "+ 1", "é", "🙂", " ", "\n", "w", "12 34", "...", "1.2.3", "a@b", "+44 20 7946 0958", "9" * 30, "()", "card ", "phone: ", "me (at) host [dot] org", "555-123-4567", "1.2.3.4.5.6.7.8.9"]
    out = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 8, 30]))) for _ in range(250)]
    out += [None, "", "z" * 5000 + "@", "a@" + "b." * 3000 + "c", "1 " * 4000, " ".join(f"u{i}@mail.org" for i in range(700))]
    return out


def test_base_spans_equal_brute_force_and_added_ones_keep_apart(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a@b.c", "x"), (3, "a@b.c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(find_pii(docs).collect(), key=lambda r: (str(r["doc_id"]), r["spans"]))
    want = sorted(((i, *brute(t), t) for i, t, _ in rows), key=lambda r: str(r[0]))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, found, joined, _ in want:
        sha = hashlib.sha256(joined.encode()).hexdigest()
        r = next(x for x in by[i] if x["base_sha256"] == sha)
        assert [r[f"n_{k}"] for k in KINDS] == [len(found[k]) for k in KINDS]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
        base = {(k, a, b) for k in KINDS for a, b in found[k]}
        assert base <= set(spans) and len(spans) == len(base) + r["n_added"]
        assert all(not (a < d and c < b) for k, a, b in set(spans) - base for _, c, d in base)
    assert find_pii(docs.limit(0)).count() == 0


def test_wide_candidates_are_learned_from_the_counts(spark):
    rng = random.Random(5)
    rows = [(i, f"call phone {rng.randrange(200, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} or write to me{i} (at) host{i} [dot] org.") for i in range(200)]
    rows += [(i, f"nothing here {i % 10}") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_pii(docs).collect()}
    assert sum(r["n_added"] >= 2 for r in got.values()) > 190 and got[250]["spans"] == ""
    plan = find_pii(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_source_of_failing_numbers_leaves_other_sources_their_cards(spark):
    rng = random.Random(8)

    def number(valid):
        d = "".join(str(rng.randrange(10)) for _ in range(15))
        d += next(c for c in "0123456789" if luhn(d + c) == valid)
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"my number {number(True)} here", f"s{i % 20}") for i in range(400)]
    rows += [(1000 + i, " and ".join(f"number {number(rng.random() < 0.1)} here" for _ in range(rng.randrange(1, 60))), "hot") for i in range(200)]
    rows += [(2000 + i, f"nothing {i}", f"s{i % 20}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for by in (None, "source"):
        got = {r["doc_id"]: r for r in find_pii(docs, source_col=by).collect()}
        assert all(got[i]["n_added"] == 1 and got[i]["spans"].startswith("card:10:") for i in range(400))
