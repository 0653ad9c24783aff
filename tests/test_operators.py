import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import audit, documents, geometry, settlement, statement
from tallyproof.sources.tables import write_results

WORDS = "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, conf double"


def test_straight_and_skewed_pages(spark):
    rng = random.Random(1)
    straight = [(1, 1, i, "w", x, x + 30.0, 14.0 * (i // 4), 14.0 * (i // 4) + 10, None) for i in range(120) for x in [rng.uniform(0, 500)]]
    band = [(2, 1, i, "w", 12.0 * i, 12.0 * i + 6, 0.1 * (12.0 * i + 3), 0.1 * (12.0 * i + 3) + 10, None) for i in range(50)]
    lined = geometry.group_lines(spark.createDataFrame(straight + band, WORDS))
    got = {r["doc_id"]: r["n"] for r in lined.groupBy("doc_id").agg(F.countDistinct("line_no").alias("n")).collect()}
    assert got == {1: 30, 2: 1}


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "FIRST bank x", None), (2, "second x", None), (3, "none", None), (4, "first", "b"), (5, None, None)], "doc_id long, text string, profile_key string")
    profiles = spark.createDataFrame([("a", 0), ("b", 1)], "key string, ordinal int")
    patterns = spark.createDataFrame([("a", "fingerprint", "first", 50), ("b", "fingerprint", "second", 10), ("a", "fingerprint", "x$", 10), ("b", "stop", "none", 9)], "key string, kind string, pattern string, weight int")
    got = {r["doc_id"]: (r["key"], r["confidence"]) for r in documents.profile_scores(docs, profiles, patterns).collect()}
    assert got == {1: ("a", 90), 2: ("a", 40), 3: ("generic", 50), 4: ("b", 97), 5: ("generic", 50)}


def test_row_scan_merges_lone_minus(spark):
    def scan(*tokens):
        words, x = [], 30.0
        for t in tokens:
            words.append((t, x, x + 6.0 * len(t)))
            x += 6.0 * len(t) + 6
        df = spark.createDataFrame([(words,)], "words array<struct<text:string,x0:double,x1:double>>")
        r = df.select(statement.row_scan(F.col("words")).alias("r")).first()["r"]
        return r["date"] and (r["date"]["m"], r["date"]["d"]), [(m["value"], m["sign"]) for m in r["moneys"]], r["description"]

    assert scan("03/03", "Shop", "1.00", "-", "-", "300.00", "5.00") == ((3, 3), [(D("1.00"), -1), (D("300.00"), -1), (D("5.00"), None)], "Shop")
    assert scan("F638", "03/03", "03/03", "REWARD", "-7.07") == ((3, 3), [(D("7.07"), -1)], "F638 REWARD")
    assert scan("Nov", "15,", "Coffee", "2.00") == ((11, 15), [(D("2.00"), None)], "Coffee") and scan("only", "words") == (None, [], "only words")


def test_wrapped_amount_and_lone_date(spark):
    lines = [(1, 1, "N", "03-03 POS Debit Store", None), (1, 2, "M", "Decatur", D("3.35")), (1, 3, "N", "03-04 nothing", None), (1, 4, "C", "end", None), (1, 5, "R", "a", D("1.00")), (1, 6, "U", "b", None)]
    df = spark.createDataFrame(lines, "doc_id long, seq long, kind string, text string, amount decimal(18,2)")
    got = [(r["description"], r["amount"]) for r in statement.wrapped_rows(df, ["doc_id"], "seq").orderBy("anchor").collect()]
    assert got == [("03-03 POS Debit Store Decatur", D("3.35")), ("a b", D("1.00"))]


def test_escrow_and_cross_foot(spark):
    parts = [(1, "previous", "10.00"), (1, "deposits", "5.00"), (1, "withdrawals", "-2.00"), (1, "new", "13.00"), (2, "new", "1.00")]
    df = spark.createDataFrame([(a, p, D(x)) for a, p, x in parts], "account long, part string, amount decimal(18,2)")
    assert {r["account"]: r["ok"] for r in settlement.escrow_rollforward(df, ["account"]).collect()} == {1: True, 2: False}
    figures = spark.createDataFrame([(1, "gross", D("9.00"), 1), (1, "deductions", D("-1.00"), 1), (1, "reimbursements", D("2.00"), 1), (1, "net_pay", D("9.00"), 1), (1, "net_pay", D("10.00"), 2), (2, "gross", D("1.00"), 1)], "doc_id long, name string, amount decimal(18,2), seq int")
    got = {r["doc_id"]: (r["net_pay_ok"], r["gross_ok"], r["passed"]) for r in settlement.cross_foot(figures, ["doc_id"]).collect()}
    assert got == {1: (True, None, True), 2: (None, None, None)}


def test_audit(spark):
    texts = spark.createDataFrame([(1, "a 1.00 b 2.50- c 3.00")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, D("-2.50"), "was 3.00")], "doc_id long, amount decimal(18,2), description string")
    assert [r["value"] for r in audit.printed_not_captured(texts, rows).collect()] == [D("1.00")]


def test_results_are_never_written_over(spark, tmp_path):
    out = spark.createDataFrame([(1, "proven"), (2, "failed")], "doc_id long, state string")
    write_results(out, f"file://{tmp_path}/out", "r1", by_state=True)
    with pytest.raises(ValueError):
        write_results(out, f"file://{tmp_path}/out", "r1", by_state=True)
    assert {r["route"] for r in spark.read.parquet(f"{tmp_path}/out/run_id=r1").collect()} == {"processed", "failed"}
