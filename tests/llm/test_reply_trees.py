import hashlib
import random

import pytest

from tallyproof.llm.reply_trees import conversation_digest, conversations, read_back

SCHEMA = "id long, parent long, role string, text string, score double, formatted string, rid int"


def brute(rows, best):
    """Chosen paths of messages with ids of their own."""
    by, under = {r[0]: r for r in rows}, {}
    for i, p, *_ in rows:
        under.setdefault(p if p in by and p != i else None, []).append(i)
    out = []
    for root in under.get(None, []):
        ends, todo = [], [(root,)]
        while todo:
            path = todo.pop()
            more = under.get(path[-1], [])
            todo += [(*path, m) for m in more]
            if not more:
                ends.append(path)
        ends.sort(key=lambda p: (-sum(by[i][4] or 0 for i in p) / len(p), p[-1]))
        out += [(p[-1], k, [(by[i][2] or "", by[i][3] or "") for i in p]) for k, p in enumerate(ends[:best], 1)]
    return sorted(out)


def made(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).coalesce(1)
    got = read_back(conversations(df, score_col="score", **more), "leaf_id", "branch")
    return sorted(((r["leaf_id"], r["branch"], [(x["role"], x["text"]) for x in r["said"]]) for r in got.collect()), key=lambda r: (r[0] is None, r)), got


HOSTILE = ["", None, "\\", "<|end|>", "<\\|end|>", "\\### Assistant: </turn> ok", "a<", "|b", "<|turn|>user<|says|>x<|end|>", "\\<|", "<<||", "é漢🙂\n\r\n"]


@pytest.mark.parametrize("best", [1, 2, 9])
def test_paths_equal_brute_force(spark, best):
    rng = random.Random(best)
    rows = []
    for i in range(1, 160):
        parent = rng.choice([None, i, 999, *([rng.randrange(1, i), i - 1] * 6 if i > 1 else [None])])
        rows.append((i, parent, rng.choice(["user", "assistant", None, "<|says|>", "\\"]), rng.choice([*HOSTILE, f"t{i}"]), rng.choice([None, 0.0, 1.0, 2.5, -1.0])))
    rows += [(i, i - 1 if i > 1000 else None, "user", f"long {i}", 0.0) for i in range(1000, 1130)]
    got, _ = made(spark, rows, best=best)
    assert got == brute(rows, best)


def test_rings_repeats_and_hot_parents(spark):
    rows = [(1, 2, "user", "ring", 0.0), (2, 1, "user", "ring", 0.0), (3, 1, "user", "on a ring", 0.0), (4, None, "user", "root", 0.0)]
    rows += [(i, 4, "assistant", f"answer {i}", float(i)) for i in range(5, 300)] + [(4, None, "user", "root", 0.0), (None, 4, "user", "no id", 1e9)]
    got, _ = made(spark, rows, best=2)
    assert got == [(4, 1, [("user", "root")]), (299, 2, [("user", "root"), ("assistant", "answer 299")]), (None, 1, [("user", "root"), ("user", "no id")])]
    assert made(spark, rows[:0])[0] == []
    with pytest.raises(ValueError):
        made(spark, rows, best=0)


def test_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*HOSTILE, f"x{c}"])) for c in range(25) for t in range(rng.randrange(1, 20))]
    rows += [(77, 0, "user", "same"), (77, 0, "user", "same"), (77, None, "assistant", "first"), (None, 1, "assistant", "none"), (None, 0, "user", "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, parent string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: [(x is not None, x if x is not None else 0) for x in r[1:]])
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        esc = lambda s: (s or "").replace("\\", "\\\\").replace("<|", "<\\|")
        chars = sum(len(esc(r)) + len(esc(t)) + len("<|turn|><|says|><|end|>") for _, _, r, t in mine)
        want.append((c, len(mine), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)), len(loss), sha(loss), chars))
    got = conversation_digest(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert conversation_digest(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
