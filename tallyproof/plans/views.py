"""Ledger and page views over the given tables, as SQL that Spark and DuckDB both read.

``{table}`` stands for a table. Doubles are written as 0.5e0, so that both engines count alike.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A user's events as a ledger: sparse end-of-day balances, planted errors, unread amounts.
EVENT_LEDGER = """
SELECT block_id, seq, day, section, cast(CASE WHEN seq % 89 <> 0 THEN signed END AS decimal(18,2)) AS amount,
       cast(0 AS decimal(18,2)) AS beginning, cast(NULL AS decimal(18,2)) AS ending,
       cast(CASE WHEN last_of_day = 1 THEN running + CASE WHEN seq % 97 = 0 THEN 0.05 ELSE 0.00 END END AS decimal(18,2)) AS balance
FROM (SELECT user_id AS block_id, event_id AS seq, cast(ts AS date) AS day, event_type AS section, signed,
             sum(signed) OVER (PARTITION BY user_id ORDER BY event_id) AS running,
             row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY event_id DESC) AS last_of_day
      FROM (SELECT user_id, event_id, ts, event_type,
                   cast(value AS decimal(18,2)) * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END AS signed
            FROM {events}) s) t
"""

#: Every third event on one account, whose balances follow from the rows' numbers, some off; all others on accounts without printed balances.
HOT_LEDGER = """
SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id + 1 END AS block_id, event_id AS seq,
       cast(CASE WHEN event_id % 3 = 0 THEN 1 + (event_id // 3) % 2 ELSE value END AS decimal(18,2)) AS amount, event_type AS section,
       cast(0 AS decimal(18,2)) AS beginning, cast(NULL AS decimal(18,2)) AS ending,
       cast(CASE WHEN event_id % 3 = 0 AND (event_id // 3) % 4 = 3 THEN (event_id // 3) + 1 + ((event_id // 3) + 1) // 2 + CASE WHEN (event_id // 3) % 67 = 3 THEN 1 ELSE 0 END END AS decimal(18,2)) AS balance
FROM {events}
"""

#: A user's events as a statement that is printed in full: balances at the end of a day, some off; every seventh user's ending is off by one.
FLOW_LEDGER = """
SELECT block_id, seq, day, section, amount, cast(0 AS decimal(18,2)) AS beginning,
       cast(running + CASE WHEN event_id % 97 = 0 THEN 0.05 ELSE 0.00 END AS decimal(18,2)) AS running, last_of_day = 1 AS closes,
       cast(total + CASE WHEN block_id % 7 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS ending,
       cast(CASE WHEN last_of_day = 1 THEN running + CASE WHEN event_id % 97 = 0 THEN 0.05 ELSE 0.00 END END AS decimal(18,2)) AS balance
FROM (SELECT user_id AS block_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, cast(ts AS date) AS day, event_type AS section, amount,
             sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running, sum(amount) OVER (PARTITION BY user_id) AS total,
             row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts DESC, event_id DESC) AS last_of_day
      FROM (SELECT user_id, event_id, ts, event_type, cast(cast(value AS decimal(18,2)) * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END AS decimal(18,2)) AS amount
            FROM {events}) s) t
"""

#: A user's events as bundles of up to six monthly statements, the fourth across a year's end; in the third, every seventh user's printed ending is off by one.
BUNDLE_LEDGER = """
SELECT doc_id, cast(dense_rank() OVER (PARTITION BY doc_id ORDER BY s) AS int) AS stmt_no, seq, start_day + 5 * part AS day, start_day, end_day, section, amount,
       cast(coalesce(upto - total, 0) AS decimal(18,2)) AS beginning, cast(upto - total + inner_sum AS decimal(18,2)) AS running,
       cast(upto + CASE WHEN doc_id % 7 = 0 AND s = 2 THEN 1 ELSE 0 END AS decimal(18,2)) AS ending, cast(n AS int) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY ts, event_id) AS seq, sum(amount) OVER (PARTITION BY doc_id, s ORDER BY ts, event_id) AS inner_sum,
             sum(amount) OVER (PARTITION BY doc_id, s) AS total, count(*) OVER (PARTITION BY doc_id, s) AS n, sum(amount) OVER (PARTITION BY doc_id ORDER BY s) AS upto,
             CASE s WHEN 0 THEN DATE '2023-09-21' WHEN 1 THEN DATE '2023-10-21' WHEN 2 THEN DATE '2023-11-21' WHEN 3 THEN DATE '2023-12-21' WHEN 4 THEN DATE '2024-01-21' ELSE DATE '2024-02-21' END AS start_day,
             CASE s WHEN 0 THEN DATE '2023-10-20' WHEN 1 THEN DATE '2023-11-20' WHEN 2 THEN DATE '2023-12-20' WHEN 3 THEN DATE '2024-01-20' WHEN 4 THEN DATE '2024-02-20' ELSE DATE '2024-03-20' END AS end_day
      FROM (SELECT user_id AS doc_id, event_id, ts, event_type AS section, cast(least((extract(day FROM ts) - 1) // 5, 5) AS int) AS s, cast((extract(day FROM ts) - 1) % 5 AS int) AS part,
                   cast(cast(value AS decimal(18,2)) * CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END AS decimal(18,2)) AS amount
            FROM {events}) a) b
"""

#: A customer's line items as a ledger with both balances; every seventh customer's ending is off by one.
LINE_LEDGER = """
SELECT o.o_custkey AS block_id,
       row_number() OVER (PARTITION BY o.o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq,
       cast(l_extendedprice AS decimal(18,2)) AS amount, l_returnflag AS section, cast(100 AS decimal(18,2)) AS beginning,
       cast(100 + sum(cast(l_extendedprice AS decimal(18,2))) OVER (PARTITION BY o.o_custkey)
            + CASE WHEN o.o_custkey % 7 = 0 THEN 1 ELSE 0 END AS decimal(18,2)) AS ending,
       cast(NULL AS decimal(18,2)) AS balance
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey
"""

#: Line items as words on pages: a page a supplier, three right-aligned columns, lines 14 points apart.
MADE_WORDS = """
SELECT l_suppkey AS doc_id, 1 AS page,
       cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS int) AS word_idx,
       cast(cast(l_extendedprice AS decimal(18,2)) AS {string}) AS text, x1 - 30e0 AS x0, x1, top, top + 10e0 AS bottom, l_quantity * 2e0 - 5e0 AS conf
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 200e0 WHEN 1 THEN 350e0 ELSE 500e0 END + (l_partkey % 30) / 10e0 AS x1,
             (l_orderkey % 40) * 14e0 + (l_linenumber % 3) * 0.5e0 AS top
      FROM {lineitem}) t
"""

#: A supplier's line items as coded rows with printed counts and sums; some are wrong.
CODE_ROWS = """
SELECT l_suppkey AS doc_id, seq, CASE WHEN seq % 10 = 0 THEN NULL ELSE cast(l_extendedprice AS decimal(18,2)) END AS amount,
       CASE WHEN seq % 10 = 0 THEN cast(CASE WHEN seq % 70 = 0 THEN 8 ELSE 9 END AS bigint) END AS printed_n,
       CASE WHEN seq % 10 = 0 THEN cast(s9 + CASE WHEN seq % 110 = 0 THEN 0.50 ELSE 0.00 END AS decimal(18,2)) END AS printed_sum
FROM (SELECT *, sum(cast(l_extendedprice AS decimal(18,2))) OVER (PARTITION BY l_suppkey ORDER BY seq ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS s9
      FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq FROM {lineitem}) a) b
"""

#: Orders as jobs: the price is the cost, line items are movements, every third row prints a subtotal.
JOB_ROWS = """
SELECT job_id, seq, amount, beginning,
       cast(CASE WHEN seq % 3 = 0 THEN beginning + running + CASE WHEN job_id % 50 = 0 THEN 0.02 ELSE 0.00 END END AS decimal(18,2)) AS balance, doc_id
FROM (SELECT *, sum(amount) OVER (PARTITION BY job_id ORDER BY seq) AS running
      FROM (SELECT o_orderkey AS job_id, o_custkey AS doc_id, cast(o_totalprice AS decimal(18,2)) AS beginning,
                   row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS seq,
                   cast(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS decimal(18,2)) AS amount
            FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey) a) b
"""


#: A user's events as statement lines on pages of twenty.
EVENT_LINES = """
SELECT user_id AS doc_id, seq, cast((seq - 1) // 20 + 1 AS int) AS page, event_type, cast(value AS decimal(18,2)) AS value, event_id,
       CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Deposits and other credits' ELSE 'Checks and DEBITS' END ELSE 'row ' || cast(event_id AS {string}) END AS text,
       CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'N' ELSE 'R' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'T' END
            WHEN 'view' THEN 'M' ELSE 'U' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM {events}) t
"""


def in_spark(sql: str, sf_dir: str) -> str:
    sql = sql.replace("{string}", "string").replace(" // ", " div ")
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)


def in_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql.replace("{string}", "varchar"))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(in_spark(sql, sf_dir))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share (``spark.checkpoint.dir``), else under the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
