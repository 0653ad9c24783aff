"""Settlements' texts are shuffled once and whole, typed rows are neither shuffled nor joined, and no text and no row is written that nothing reads again."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyproof.operators import grammars, reconcile, route, settlement
from tallyproof.plans import queries as Q

D = "/root/testdata/sf0.001"
READERS = {"jobs": (grammars.job_rows, Q.JOB_WORDS), "codes": (grammars.coded_rows, Q.CODE_WORDS), "loads": (grammars.load_rows, Q.LOAD_WORDS)}


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.find("== Initial Plan ==")]


def shuffles(plan):
    return sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in plan.splitlines())


def written(spark):
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return {x for x in (os.listdir(at) if os.path.isdir(at) else []) if "-" in x and os.path.exists(f"{at}/{x}/_SUCCESS")}


@pytest.mark.parametrize("name", READERS)
def test_lines_are_shuffled_once_as_texts(spark, monkeypatch, name):
    read, words = READERS[name]
    seen = []
    monkeypatch.setattr(grammars, "shared_table", lambda df, _: seen.append(df) or df)
    texts = spark.createDataFrame([(i, "a\nb") for i in range(9)], "doc_id long, text string")
    rows = read(texts, words)
    plan = executed(rows)
    assert len(seen) == 1 and shuffles(plan) == 1 and "Join" not in plan


@pytest.mark.parametrize("name, tables, most", [("settlement_projection", 0, 6), ("settlement_route", 1, 13)])
def test_what_settlements_write_and_shuffle(spark, name, tables, most):
    before = written(spark)
    plan = executed(entry.queries()[name](spark, D))
    assert len(written(spark) - before) == tables
    assert 0 < shuffles(plan) <= most


def test_texts_are_made_once_for_all_kinds(spark):
    plan = executed(route.typed_rows(Q._settlement_texts(spark, D), Q.KINDS))
    assert sum("ReusedExchange" in x and "texts" in x for x in plan.splitlines()) == len(Q.KINDS)  # jobs' texts are read twice, for what stands behind them too


def test_settlements_without_rows_and_slim_rows(spark):
    texts = ["x-JB y Total Jobs: none", "a 1-JB b\nAnn $1.00 1-JB $5.00 Total Cost\n$5.00\nTotal Jobs: $5.00\nTOTAL PAY TO DRIVER $5.00", "Deduct/Earning code", "prose", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [route.settlement_outcomes(*route.settlement_rows(docs, Q.KINDS, whole=w)).orderBy("doc_id").collect() for w in (True, False)]
    assert kept[0] == kept[1]
    assert [(r.doc_id, r.rows, r.state, r.profile) for r in kept[0]] == [(0, 0, "failed", "jobs"), (1, 5, "proven", "jobs"), (2, 0, "failed", "codes")]


def test_notes_without_a_join_are_those_of_chain_flags(spark):
    dice = random.Random(4)
    rows = []
    for block in range(40):
        at = Decimal(dice.randint(0, 500)) / 100
        beginning = None if block % 9 == 0 else at
        for seq in range(dice.randint(1, 12)):
            amount = None if dice.random() < 0.1 else Decimal(dice.randint(-300, 300)) / 100
            at += amount or 0
            balance = at + (Decimal("0.05") if dice.random() < 0.3 else 0) if dice.random() < 0.4 else None
            rows.append((block, seq, amount, beginning, balance))
    ledger = spark.createDataFrame(rows, "block int, seq int, amount decimal(18,2), beginning decimal(18,2), balance decimal(18,2)")
    want = {(r.block, r.seq): r.note for r in reconcile.chain_flags(ledger, ["block"], ["seq"]).collect()}
    apart = ledger.unionByName(ledger.withColumn("seq", F.col("seq") + 100))
    chain = F.when(F.col("seq") < 100, F.col("block"))  # rows of no chain stand between the chains
    notes = reconcile.chain_notes(apart.withColumn("doc", F.floor(F.col("block") / 7)), ["doc"], ["block", "seq"], chain, F.col("amount"), F.col("balance"), F.col("beginning"))
    assert not notes.filter("seq >= 100 and note is not null").count()
    notes = notes.filter("seq < 100")
    assert {(r.block, r.seq): r.note or "" for r in notes.collect()} == want and len(set(want.values())) > 10


def test_an_unreadable_count_closes_no_group(spark):
    text = "AB FUEL\nPAY1 Some Name 01/02/2024 5.00\nDeduct/Earning code AB totals: 99999999999999999999 Records 5.00\nPAY2 Other 01/02/2024 1.00\nDeduct/Earning code AB totals: 1 Records 1.00\nPAY3 Third 01/02/2024 2.00\nDeduct/Earning code AB totals: 1 Records 2.00"
    rows = grammars.coded_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), Q.CODE_WORDS)
    assert [r.status for r in rows.orderBy("line_no").collect()] == ["NEEDS_REVIEW"] * 4 + ["OK"] * 2  # two rows up to the first count that can be read
    total = settlement.report_totals(grammars.coded_totals(rows), ["doc_id"], ["line_no"]).first()
    assert (total["rows"], total["codes"], total["mismatches"]) == (3, 2, 1)
