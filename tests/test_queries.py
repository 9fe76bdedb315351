"""Every registered family query against its SQL."""

import duckdb
import pytest

from cohortry import queries as families

FOLDER = "/root/testdata/sf0.001"
SQL = families.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = families.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(r) for r in db.sql(SQL[name]).select(*cols).fetchall()), key=repr)
    assert got == want


def test_filter_reaches_the_scan(spark):
    df = families.queries()["order_count_in_period"](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
