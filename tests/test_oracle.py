"""Every registered query with SQL gives the same rows in Spark and DuckDB on the smallest tables; the others run."""

import decimal
import math
import os

import duckdb
import pytest

from gallerylens.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, (bool, str)) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6f}"
    return str(v).removesuffix("+00:00")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query(spark, duck, key):
    df = catalog.queries()[key](spark, DATA)
    got = rows(df.columns, df.collect())
    if sql := catalog.oracle_sql().get(key):
        found = duck.sql(sql)
        assert got == rows(found.columns, found.fetchall())
    else:
        assert got[1]
