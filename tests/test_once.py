"""What a row's text says is worked out once: plans in which a pattern's result is written out again for every use of it grow past these bounds."""

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def patterns(spark, name):
    plan = entry.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_") + plan.lower().count("rlike")


@pytest.mark.parametrize("name, most", [("date_tokens", 6), ("statement_periods", 24), ("statement_periods_more", 24)])
def test_patterns_are_applied_once(spark, name, most):
    assert 0 < patterns(spark, name) <= most
