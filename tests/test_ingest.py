import os
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import reconcile, scan, statement
from tallyproof.sources.tables import write_results
from tallyproof.streaming.ingest import ingest_documents

SCHEMA = "doc_id long, amount decimal(18,2)"


def drop(spark, folder, doc, n):
    path = f"{folder}/doc {doc}.parquet"
    tmp = f"{folder}_made_{doc}"
    spark.createDataFrame([(doc, D(i)) for i in range(n)], SCHEMA).coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    os.rename(next(f"{tmp}/{x}" for x in os.listdir(tmp) if x.endswith(".parquet")), path)


def test_one_bad_document_fails_alone(spark, tmp_path):
    source, out, log = str(tmp_path / "in"), str(tmp_path / "out"), []
    for doc in range(5):
        drop(spark, source, doc, doc)
    with open(f"{source}/broken.parquet", "w") as f:
        f.write("this is no table")
    totals = lambda rows: rows.withColumn("ratio", F.expr("if(doc_id = 7, raise_error('seven'), 1)")).groupBy("doc_id").agg(F.sum("amount").alias("total"), F.max("ratio").alias("ratio"))
    ingest_documents(spark, source, SCHEMA, totals, out, str(tmp_path / "check"))
    drop(spark, source, 6, 3)
    drop(spark, source, 7, 3)
    ingest_documents(spark, source, SCHEMA, totals, out, str(tmp_path / "check"), files_a_batch=10)
    ingest_documents(spark, source, SCHEMA, totals, out, str(tmp_path / "check"))
    read = spark.read.parquet(f"{out}/results").select("doc_id", "total")
    assert sorted(map(tuple, read.collect())) == [(1, D(0)), (2, D(1)), (3, D(3)), (4, D(6)), (6, D(3))]
    log = {os.path.basename(r["path"]).replace("%20", " "): (r["state"], r["rows"], r["batch"], r["reason"]) for r in spark.read.parquet(f"{out}/log").collect()}
    assert {k: v[:3] for k, v in log.items()} == {
        "doc 0.parquet": ("empty", 0, 0), "doc 1.parquet": ("read", 1, 0), "doc 2.parquet": ("read", 2, 0), "doc 3.parquet": ("read", 3, 0), "doc 4.parquet": ("read", 4, 0),
        "broken.parquet": ("failed", 0, 0), "doc 6.parquet": ("read", 3, 1), "doc 7.parquet": ("failed", 0, 1),
    }
    assert log["broken.parquet"][3] and "seven" in log["doc 7.parquet"][3]
    ingest_documents(spark, source, SCHEMA, totals, out, str(tmp_path / "again"))  # from the start, into the same place
    assert spark.read.parquet(f"{out}/results").filter("batch = 0").count() == 5


def test_all_documents_failing_is_the_jobs_fault(spark, tmp_path):
    source = str(tmp_path / "in")
    for doc in (1, 2):
        drop(spark, source, doc, 2)
    bad = lambda rows: rows.withColumn("x", F.raise_error(F.lit("always")))
    with pytest.raises(Exception, match="every document"):
        ingest_documents(spark, source, SCHEMA, bad, str(tmp_path / "out"), str(tmp_path / "check"))


def test_a_run_has_one_writer(spark, tmp_path):
    path = str(tmp_path / "runs")
    made = lambda n: spark.range(n).select("id", F.when(F.col("id") == 1, "failed").otherwise("proven").alias("state"))

    def write(n):
        try:
            write_results(made(n), path, "r1", by_state=True)
            return n
        except ValueError:
            return 0

    with ThreadPoolExecutor(2) as both:
        won = list(both.map(write, (3, 5)))
    assert sorted(won)[0] == 0 and spark.read.parquet(f"{path}/run_id=r1").count() == max(won) > 0
    assert write(4) == 0
    write_results(made(2), path, "r2", owner="me")
    with pytest.raises(ValueError):
        write_results(made(2), path, "r2", owner="me")
    assert spark.read.parquet(f"{path}/run_id=r2").count() == 2


def test_chunks_give_what_windows_give(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("block_id"), F.col("id").alias("seq"), F.when(F.col("id") % 89 != 0, (F.col("id") % 7 - 3)).cast("decimal(18,2)").alias("amount"),
        F.lit(0).cast("decimal(18,2)").alias("beginning"), F.lit(None).cast("decimal(18,2)").alias("ending"), F.when(F.col("id") % 5 == 0, F.col("id") % 11).cast("decimal(18,2)").alias("balance"),
        F.when(F.col("id") % 17 == 0, F.lit("Deposits")).otherwise("x").alias("text"),
    )
    cut = scan.chunked(rows, ["block_id"], ["seq"], 7)
    assert cut.filter("block_id = 0").select("chunk").distinct().count() >= 2
    for f in (reconcile.block_proof, reconcile.chain_flags, reconcile.chain_segments):
        want, got = f(rows, ["block_id"], ["seq"]), f(cut, ["block_id"], ["seq"])
        cols = want.columns
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))
    direction = F.when(F.col("text") == "Deposits", 1)
    fill = lambda x: sorted(map(str, statement.section_fill(x, ["block_id"], ["seq"], F.col("text"), direction, F.col("seq") % 101 == 0).select("seq", "section", "section_dir").collect()))
    assert fill(cut) == fill(rows)
