"""Every named query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from pagelathe.plans import queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    made = queries.queries()[name](spark, TABLES)
    columns = sorted(made.columns)
    told = duck.execute(queries.oracle_sql()[name])
    heads = [d[0] for d in told.description]
    assert sorted(heads) == columns
    want = sorted((tuple(plain(r[heads.index(c)]) for c in columns) for r in told.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_twin(spark, name):
    assert queries.queries()[name](spark, TABLES).columns
