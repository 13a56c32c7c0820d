"""Every registered query with SQL against DuckDB, by value, where the driver's tables are there."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"))))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    told = duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]}) t")
    assert plain(df.select(*columns).collect()) == plain(told.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 20


def test_top_rows_are_kept_per_partition(spark):
    plan = entry.queries()["topk"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
