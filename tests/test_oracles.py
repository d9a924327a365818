"""Every query with SQL gives the rows of that SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from jobs import registry as jobs
from rangeflow.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | jobs.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | jobs.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return [names[k] for k in order], sorted([[text(r[k]) for k in order] for r in data])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(ORACLE_SQL[name])
    assert got == rows([d[0] for d in rel.description], rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
