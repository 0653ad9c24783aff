import random
import re

from tallyproof.llm.quality_rules import RULES, STOP_WORDS, quality

STOP = {w for ws in STOP_WORDS.values() for w in ws}


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                hit.update(range(p, p + 5))
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "one", "a b c d e " * 3, "x\n" * 40, "é ß\x0b漢字 # $ % | <b>\n\nx y\r\nx y"]
    for size in (1, 4, 5, 6, 30, 200):
        for kinds in (2, 5, 500):
            out.append(rng.choice(["", " "]) + "".join(rng.choice([f"w{rng.randrange(kinds)}", "the"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(size)))
    out.append("p q r s t u " + " ".join(f"n{i}" for i in range(300)) + " p q r s t u")
    return out


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "a b", "x"), (3, "one", "x")]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()
    want = [(i, *brute(t)) for i, t, _ in rows]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_verdicts(spark):
    prose = "The cat sat on the mat and looked at a bird that was sitting in a tree near the old house by the river."
    rows = [(0, prose), (1, "zzz " + " ".join(f"q{i}" for i in range(50))), (2, prose.replace(" ", "### ")), (3, (prose + "\n") * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    assert got[0]["kept"] and got[0]["failed_rules"] == []
    assert "stop_words_per_word" in got[1]["failed_rules"] and not got[1]["kept"]
    assert "symbols_per_word" in got[2]["failed_rules"]
    assert got[3]["base_failed"]
    assert quality(docs.limit(0)).count() == 0
    plan = quality(docs, rules=RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(140_000)) + "\n" + "the a of " * 5000
    got = quality(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert tuple(got)[:7] == (1, *brute(long))
