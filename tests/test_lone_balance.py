from tallyproof.operators import flow
from tallyproof.operators.profiles import Profile

WORDS = "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double"
SAID = [
    [("Account", 80), ("No-1", 140)], [("Beginning", 80), ("balance", 140), ("$0.00", 200)],
    [("01/02/2024", 80), ("Card", 110), ("click", 150), ("10.00", 400)], [("01/02/2024", 80), ("Card", 110), ("click", 150), ("5.00", 400), ("15.50", 500)],
    [("Ending", 80), ("balance", 140), ("$15.00", 200)],
]


def proofs(spark, running):
    words = [(1, 1, 10 * i + k, t, x - 40.0, float(x), 14.0 * i, 14.0 * i + 10) for i, line in enumerate(SAID) for k, (t, x) in enumerate(line)]
    profile = Profile(markers=(r"^Account\s+(No-\d+)",), credit_words=("click",), running_balance=running)
    return flow.statement_proofs(spark.createDataFrame(words, WORDS), profile).collect()


def test_the_only_balance_of_a_page_is_read(spark):
    [found] = proofs(spark, True)
    assert found["rows"] == 2 and found["passed"] and found["flagged"] == 2  # 15.50 is not 10.00 + 5.00


def test_without_running_balances_a_lone_figure_is_no_balance(spark):
    [found] = proofs(spark, False)
    assert found["rows"] == 2 and found["passed"] and found["flagged"] == 0
