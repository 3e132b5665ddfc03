"""The queries that SQL can express give the same rows in Spark and DuckDB."""

import os

import duckdb
import pytest

from gallerylens.llm import queries

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query(spark, key):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found = con.sql(queries.oracle_sql()[key])
    df = queries.queries()[key](spark, DATA)
    order = sorted(found.columns)
    assert order == sorted(df.columns)
    assert sorted(map(str, df.select(*order).toPandas().itertuples(index=False, name=None))) == sorted(map(str, found.project(", ".join(order)).df().itertuples(index=False, name=None)))
