from tallyproof.operators import flow
from tallyproof.operators.profiles import Profile

from .test_lone_balance import SAID, WORDS


def test_an_amount_of_nothing_needs_no_direction(spark):
    said = [*SAID[:3], [("01/02/2024", 80), ("Card", 110), ("shop", 150), ("0.00", 400)], [("Ending", 80), ("balance", 140), ("$10.00", 200)]]
    words = [(1, 1, 10 * i + k, t, x - 40.0, float(x), 14.0 * i, 14.0 * i + 10) for i, line in enumerate(said) for k, (t, x) in enumerate(line)]
    [found] = flow.statement_proofs(spark.createDataFrame(words, WORDS), Profile(markers=(r"^Account\s+(No-\d+)",), credit_words=("click",))).collect()
    assert found["rows"] == 2 and found["passed"] and found["flagged"] == 0
