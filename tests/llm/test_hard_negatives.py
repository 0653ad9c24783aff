import math
import random

import pytest
from pyspark.sql import functions as F

from tallyproof.llm.hard_negatives import hard_negatives

INF = float("inf")


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    fine = []
    for k, (i, v, y) in enumerate(rows):
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((k, i, [math.floor(256 * x) for x in v], y))
    out = []
    place = lambda i: (i is None, i or 0)
    for k, i, v, y in fine:
        if not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), place(j), j, z) for m, j, w, z in fine if m != k), key=lambda r: r[:2])
        for s, _, p, z in [r for r in scored if r[3] == y][:positives]:
            inside = [(n, -t) for t, _, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, rank, n, -s, t) for rank, (n, t) in enumerate(inside[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, rid string, part int")
    return sorted(map(tuple, hard_negatives(df, F.col("id") % 4 == 0, **more).collect()), key=str)


def anchor(i):
    return i is not None and i % 4 == 0


def exact(x):
    return math.floor(x * 64) / 64


def test_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(260):
        rows.append((i, [exact(rng.gauss(0, 0.3)) for _ in range(19)], rng.randrange(3)))
    for i in range(260, 330):
        rows.append((i, [exact(x + rng.gauss(0, 0.02)) for x in rows[8][1]], rng.randrange(2)))
    rows += [(i, rows[8][1], 0) for i in range(330, 350)] + [rows[12], rows[12], (None, rows[12][1], 1), (None, rows[16][1], 2)]
    rows += [(400, None, 1), (404, rows[3][1], None), (408, [0.5, None], 1), (412, [float("nan")] * 19, 1), (416, [INF] * 19, 0), (420, [], 1), (424, [0.25, -0.5], 0), (428, [0.0] * 19, 2)]
    got = mined(spark, rows)
    want = brute(rows, anchor)
    assert len(want) > 500 and got == want
    assert mined(spark, rows, rows_a_part=20, positives=2, negatives=3, low=50) == brute(rows, anchor, 2, 3, 50)


def test_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], 2), (5, [-1.0, 0.0], 2), (4, [-1.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows, anchor) != []
    assert mined(spark, rows[:1]) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, rows[:0]) == []


@pytest.mark.parametrize("size", [3e3, 1e6, 1e13])
def test_large_components_stay_exact(spark, size):
    rng = random.Random(int(size))
    rows = [(i, [float(math.floor(rng.gauss(0, size))) for _ in range(10)], i % 2) for i in range(60)]
    got, want = mined(spark, rows, "double"), brute(rows, anchor)
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    if size < 1e10:
        assert got == want
    else:
        assert {r[:1] for r in got} <= {r[:1] for r in want} and all(clip(r[4]) == r[4] for r in got)


def test_no_cross_join(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 1.0], i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int")
    plan = hard_negatives(df, F.col("id") % 4 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
