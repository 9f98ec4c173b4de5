"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from vigilspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{source}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return "NULL"
        number = isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_))
        return f"{float(v):.6f}" if number else str(v)  # a column with nulls comes back as floats

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
