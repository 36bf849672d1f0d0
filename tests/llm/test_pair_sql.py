"""The similarity joins against exhaustive SQL on a whole small table."""

import duckdb
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "table"), [("op5_embedding_dedup", "embeddings"), ("op6_ngram_join", "documents")])
def test_query_equals_exhaustive_sql(spark, query, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.sql(queries.ORACLE_SQL[query])
    df = queries.QUERIES[query](spark, SF)
    assert df.columns == result.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
