"""Jobs are dealt into parts by the size of the table: one shuffle of the items, however many steps follow by the job."""

from decimal import Decimal

import __spark_entry__ as entry
from tallyproof.operators import settlement
from tallyproof.sources.tables import spread

D = "/root/testdata/sf0.001"


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning")


def test_parts_grow_with_the_table(spark):
    parts = [spread(spark.range(n), "id", rows_each=100).rdd.getNumPartitions() for n in (50, 1000, 6000)]
    assert parts == [spark.sparkContext.defaultParallelism, 10, 60]


def test_job_chain_shuffles_items_once(spark):
    assert shuffles(entry.queries()["job_chain"](spark, D)) == 1


def test_job_nets_shuffle_once_and_follow_the_last_subtotal(spark):
    rows = [
        (1, 1, "5", "10", None), (1, 2, "3", "10", "18"), (1, 3, None, "10", None), (1, 4, "2", "10", None),  # 18 + 2
        (2, 1, None, "7", None), (2, 2, "-1", "7", None),  # 7 - 1
        (3, 1, None, "4", None), (4, 1, None, "4", "9"), (4, 2, "1", "4", None), (4, 2, "2", "4", "11"),  # 4; 11, as both rows stand at its place
        (None, 1, "1", "1", None),
    ]
    money = lambda x: None if x is None else Decimal(x)
    table = spark.createDataFrame([(*r[:2], *map(money, r[2:])) for r in rows], "job long, at int, amount decimal(18,2), beginning decimal(18,2), balance decimal(18,2)")
    nets = settlement.job_nets(table, ["job"], ["at"])
    assert {r.job: int(r.net) for r in nets.collect()} == {1: 20, 2: 6, 3: 4, 4: 11}
    assert shuffles(nets) == 1
