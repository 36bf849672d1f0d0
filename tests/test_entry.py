"""Every registered query with SQL gives the rows of that SQL."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(f"{v:.7g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("op") or n == "optimal_bands"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = QUERIES[name](spark, SF), con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["reason", "n"]
    assert set(SQL) <= set(QUERIES)
