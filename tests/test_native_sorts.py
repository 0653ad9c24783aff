"""Arrays are sorted by sort_array: array_sort compares their elements by an expression that is interpreted for each pair."""

import __spark_entry__ as entry
from tallyproof.operators import geometry
from tallyproof.plans import queries as Q

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_put_together_by_native_sorts(spark):
    said = plan(entry.queries()["document_kind"](spark, D))
    assert "sort_array(" in said and "array_sort(" not in said


def test_pages_are_put_together_by_native_sorts(spark):
    said = plan(geometry.page_lines(Q._words(spark, D)))
    assert "sort_array(" in said and "array_sort(" not in said
