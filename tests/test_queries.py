"""Every registered query against its SQL in DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalog_more  # noqa: F401  adds to the catalog
from graphloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert mine == sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None
