"""The registered training-data queries: those with SQL against DuckDB, all of them on the driver's smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
NAMES = [f"op{n}" for n in range(1, 11)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def plain(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op") and n[2].isdigit()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    told = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]}) t")
    assert sorted(told.columns) == columns == sorted(con.sql(entry.oracle_sql()[name]).columns)
    assert plain(df.select(*columns).collect()) == plain(told.fetchall())


def test_each_operator_has_one_query():
    found = sorted((n for n in entry.queries() if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in found] == NAMES and "pipeline" in entry.queries()


def test_mined_rules_are_those_of_the_sql(spark, tmp_path):
    """Labels that depend on the urls: rules are mined, in both."""
    import random

    import duckdb

    from sieveframe.llm.queries import SQL, op3_url_rules

    rng = random.Random(17)
    hosts = ["win1.example.net", "www.win7.com", "blog.example.org", "a.b.fr", "EXAMPLE.org"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en/1', 'es/', 'x/cash-now', 'cash'])}{rng.choice(['', '?p=1&q=2', '#top'])}" for _ in range(220)]
    urls += [None, "", "no-host", "x://h"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])]
    labels = [(i, 0 if "win" in (u or "") and "cash" in (u or "") else 1, 0) for i, u in enumerate(urls) if i % 2] + [(None, 0, 0), (7, None, 0), (7, 1, 0)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = op3_url_rules(spark, str(tmp_path))
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert plain(rows) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({SQL['op3_url_rules']}) t").fetchall())
    assert sum(r.mined_rule is not None for r in rows) > 20 and any(r.rule is None and r.verdict == "block" for r in rows)
