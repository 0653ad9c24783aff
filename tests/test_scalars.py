import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyproof.functions import scalars as S
from tallyproof.operators.documents import account_number, find_period


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_money(spark):
    cases = {"1,003.00-": (D("1003.00"), -1), "-$30.00": (D("30.00"), -1), "$466.53": (D("466.53"), None), ".68": (D("0.68"), None), "+5.00": (D("5.00"), 1),
             "(5.00": (D("5.00"), -1), "(12.50)": (D("12.50"), -1), "12": None, "1,23.00": None, "": None, "abc": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.money(F.col("t")).alias("m")).collect()
    assert {r["t"]: (r["m"]["value"], r["m"]["sign"]) if r["m"] else None for r in rows} == cases


def test_figures_years_and_noise(spark):
    assert one(spark, "paid $1,250.00 and 3.50- not 2022 or .68", S.money_in_text) == [D("1250.00"), D("3.50")]
    assert one(spark, "fee 2,000.00 total", S.years_in_text) == [] and one(spark, "balance 2022 total", S.years_in_text) == [2022]
    assert one(spark, "_1 2.50_", S.clean_amount) == D("12.50") and one(spark, "12", S.clean_amount) is None
    assert one(spark, "a   b\tc", S.collapsed) == "a b c" and one(spark, "a  b", S.squashed) == "ab" and one(spark, "añ1-b", S.letters) == 3


def test_dates(spark):
    cases = {"01/31": (1, 31, None), "1-31": (1, 31, None), "12/16/25*": (12, 16, 2025), "1-2-1999": (1, 2, 1999), "13/01": None, "1/32": None, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.date_token(F.col("t")).alias("d")).collect()
    assert {r["t"]: tuple(r["d"])[:3] if r["d"] else None for r in rows} == cases
    day = lambda t: one(spark, t, lambda c: S.resolve_year(S.date_token(c), F.lit("2021-12-14").cast("date"), F.lit("2022-01-13").cast("date")))
    assert day("01/03") == dt.date(2022, 1, 3) and day("12/17") == dt.date(2021, 12, 17) and day("06/01") is None and day("2/30/2022") is None
    assert tuple(one(spark, "Nov", lambda c: S.month_name_date(c, F.lit("15,"))))[:2] == (11, 15)
    assert one(spark, "Novem", lambda c: S.month_name_date(c, F.lit("15"))) is None


def test_period_and_account(spark):
    period = lambda t: (lambda p: p and (p["start"], p["end"]))(one(spark, t, find_period))
    jan = (dt.date(2022, 1, 1), dt.date(2022, 1, 31))
    assert period("January 01, 2022throughJanuary 31, 2022") == jan and period("for 1/1/22 to 01/31/2022") == jan
    assert period("Dec 14 - Jan 13, 2022") == (dt.date(2021, 12, 14), dt.date(2022, 1, 13))
    assert period("closing March 31, 2022") == (dt.date(2022, 2, 24), dt.date(2022, 3, 31))
    assert period("1/5/2022 x 1/9/22 y 2/1/2022") == (dt.date(2022, 1, 5), dt.date(2022, 2, 1)) and period("none") is None
    assert period("January 1,2022 through January 31,2022") == jan and period("Sept. 2 2022 thru Sep 30, 2022") == (dt.date(2022, 9, 2), dt.date(2022, 9, 30))
    assert period("previous balance as of 02/28/25 and so on; newbalanceasof03/31/2025") == (dt.date(2025, 2, 28), dt.date(2025, 3, 31))
    assert period("Mar 3 2024") is None and period("previous balance as of 02/28/2025" + " x" * 200 + " new balance as of 03/31/2025") is None
    assert one(spark, "Account: 12-345", lambda c: account_number(c, r"Account:\s*([0-9-]+)")) == "12-345"
    assert one(spark, "Account: 123", lambda c: account_number(c, r"Account:\s*([0-9-]+)")) is None
