"""Every query with SQL gives what DuckDB gives, on the smallest tables; the contract of the entry module."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from lexloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(df):
    def f(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return str([f(x) for x in v])
        if v is None or pd.isna(v):
            return "~"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and v.dtype.kind in "if":
            return repr(round(float(v), 3) + 0.0)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(f, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
