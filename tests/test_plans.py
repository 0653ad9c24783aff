import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    pages = [(i, f"u{i}", "é" * (37 * i % 9000) + ("Page 1 of 9" if i % 11 == 0 else "") + "tail") for i in range(90)] + [(90, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    texts = [(i, " ".join(f"paid {k}.{i % 90 + 10}" for k in range(i % 7)) + " and 1.00" * (i % 2)) for i in range(40)] + [(40, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["native_pages", "statement_split_pages", "printed_vs_altered"])
def test_whole_tables_equal_their_sql(spark, tables, name):
    found = entry.queries()[name](spark, tables)
    with duckdb.connect() as db:
        for t in ("pages", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    assert sorted(map(tuple, found.select(names).collect())) == sorted(rows) and rows
    if name == "native_pages":  # every character of every page counts, and both outcomes occur
        assert sum(r[names.index("chars")] for r in rows) == sum(37 * i % 9000 + 4 + 11 * (i % 11 == 0) for i in range(90))
        assert {r[names.index("is_native")] for r in rows} == {True, False}
    if name == "printed_vs_altered":
        assert {r[0] % 2 for r in rows} == {0, 1}
    if name != "printed_vs_altered":  # documents grow with the table
        assert len({r[names.index("doc_id")] for r in rows}) == 1 + 90 // (5 if name == "native_pages" else 12)


@pytest.mark.parametrize("name", sorted(set(entry._oracle.ORACLE_SQL) - {"cross_foot", "cross_foot_parts", "report_totals"}))
def test_statement_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    found = entry.queries()[name](spark, d)
    with duckdb.connect() as db:
        for t in ("customer", "lineitem", "orders", "events", "documents", "pages", "part", "supplier", "nation", "region", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    assert sorted(found.columns) == sorted(names)
    near = lambda t: tuple(round(x, 6) if isinstance(x, float) else x for x in t)
    assert sorted(map(near, found.select(names).collect()), key=str) == sorted(map(near, rows), key=str) and rows


@pytest.mark.parametrize("name", ["cross_foot", "cross_foot_parts", "report_totals"])
def test_settlement_proofs_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    found = entry.queries()[name](spark, d)
    with duckdb.connect() as db:
        for t in ("customer", "lineitem"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
        want = db.execute(entry.oracle_sql()[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(rows) and {False} < {r[-1] for r in rows}
