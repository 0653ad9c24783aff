import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyproof.operators import reconcile as R

LEDGER = "block_id long, seq long, amount decimal(18,2), balance decimal(18,2), beginning decimal(18,2), ending decimal(18,2), section string"


def ledger(spark, rows):
    d = lambda x: None if x is None else D(str(x))
    return spark.createDataFrame([(b, s, d(a), d(bal), d(beg), d(end), sec) for b, s, a, bal, beg, end, sec in rows], LEDGER)


def fold(rows, beginning):
    """The chain rule, row by row."""
    out, last, group = [], beginning, []
    for i, (a, b) in enumerate(rows):
        if a is None:
            group, last = [], b
            continue
        group.append(i)
        if b is not None:
            if last is not None:
                ok = abs(sum(rows[j][0] for j in group) - (b - last)) <= D("0.01")
                out += [(j, ok) for j in group]
            last, group = b, []
    return out


def test_chain_equals_a_fold(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for block in range(40):
        part, running = [], D(0)
        for _ in range(rng.randrange(1, 40)):
            a = D(rng.randrange(-500, 500)) / 100
            running += a
            shown = running + (D("0.05") if rng.random() < 0.1 else 0) if rng.random() < 0.4 else None
            part.append((None if rng.random() < 0.1 else a, shown))
        start = rng.choice([D(0), None])
        want |= {(block, j) for j, ok in fold(part, start) if not ok}
        rows += [(block, j, a, b, start, None, "x") for j, (a, b) in enumerate(part)]
    got = R.chain_flags(ledger(spark, rows), ["block_id"], ["seq"]).filter("status = 'NEEDS_REVIEW'").collect()
    assert {(r["block_id"], r["seq"]) for r in got} == want and all(r["note"] for r in got)


def test_single_mismatch_carries_its_figures(spark):
    rows = [(1, 1, "16.34", "53.66", 100, None, "x")]
    note = R.chain_flags(ledger(spark, rows), ["block_id"], ["seq"]).first()["note"]
    assert "16.34" in note and "-46.34" in note


def test_block_proof(spark):
    rows = [(1, 1, 10, None, 100, None, ""), (1, 2, 20, None, 100, None, ""), (1, 3, -5, 125, 100, None, ""),
            (2, 1, 10, None, 100, 999, ""), (2, 2, 20, None, 100, 999, ""), (3, 1, 1, None, None, None, ""), (4, 1, 50, None, 100, 150, "")]
    got = {r["block_id"]: r for r in R.block_proof(ledger(spark, rows), ["block_id"], ["seq"]).collect()}
    assert [got[i]["passed"] for i in (1, 2, 3, 4)] == [True, False, None, True] and got[2]["flagged"] == 0
    assert "off by 869.00" in got[2]["detail"]


def test_section_totals_stay_in_their_block(spark):
    rows = [(1, 1, 10, None, None, None, "Deposits and Additions"), (2, 1, 7, None, None, None, "Deposits and Additions"), (2, 2, -3, None, None, None, "Fees")]
    totals = spark.createDataFrame([(1, "Deposits and Additions", D("10.00")), (2, "Deposits and Additions", D("8.00")), (2, "Nothing", D("1.00"))], "block_id long, name string, amount decimal(18,2)")
    got = R.section_mismatches(ledger(spark, rows), totals, ["block_id"]).collect()
    assert [(r["block_id"], r["printed"], r["found"]) for r in got] == [(2, D("8.00"), D("7.00"))]


def test_printed_group_totals(spark):
    d = D("5.00")
    rows = [(1, 1, d, None, None), (1, 2, d, None, None), (1, 3, None, 2, D("10.00")), (1, 4, d, None, None), (1, 5, None, 2, d), (1, 6, d, None, None), (1, 7, None, 1, D("9.00"))]
    df = spark.createDataFrame(rows, "doc_id long, seq long, amount decimal(18,2), printed_n long, printed_sum decimal(18,2)")
    got = R.printed_group_totals(df, ["doc_id"], ["seq"]).orderBy("seg").collect()
    assert [r["mismatch"] for r in got] == [None, "count", "sum"]


def test_an_unread_amount_is_never_proven(spark):
    # the balance jumps over the unread amount; all that could be checked agrees
    rows = [(1, 1, 10, 110, 100, None, ""), (1, 2, None, 500, 100, None, ""), (1, 3, 5, 505, 100, None, ""),
            (2, 1, 10, 110, 100, 120, ""), (2, 2, 10, None, 100, 120, ""), (2, 3, None, None, 100, 120, ""), (3, 1, 10, 110, 100, None, "")]
    proofs = R.block_proof(ledger(spark, rows), ["block_id"], ["seq"])
    got = {r["block_id"]: (r["passed"], r["flagged"]) for r in proofs.collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (True, 0)}
    blocks = proofs.selectExpr("block_id AS doc_id", "block_id AS block", "'a' AS block_name", "rows", "flagged", "passed", "detail", "true AS complete")
    out = {r["doc_id"]: (r["state"], r["verdict"]) for r in R.document_outcome(blocks, ["doc_id"]).collect()}
    assert out == {1: ("unproven", "FAILED"), 2: ("unproven", "NOT PROVABLE"), 3: ("proven", "PASSED")}
    marked = ledger(spark, rows).withColumn("status", F.when(F.col("block_id") == 3, "NEEDS_REVIEW").otherwise("OK"))
    assert {r["block_id"]: r["passed"] for r in R.block_proof(marked, ["block_id"], ["seq"]).collect()}[3] is False
    assert R.run_severity(R.document_outcome(blocks, ["doc_id"])).first()["severity"] == 1
    assert R.run_severity(R.document_outcome(blocks.limit(0), ["doc_id"])).first()["severity"] == 3
    assert [tuple(r) for r in R.unexpected_states(R.document_outcome(blocks, ["doc_id"]), ["proven"]).collect()] == [("unproven", 2)]
    read = spark.createDataFrame([(1, 3, 5), (1, None, 2), (2, 9, 4)], "doc_id long, stop_page int, pages int")
    assert {r["doc_id"]: r["pages_read"] for r in R.pages_read(read, ["doc_id"]).collect()} == {1: 5, 2: 4}
