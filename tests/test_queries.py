"""Every registered program query against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if hasattr(v, "date") and callable(v.date):
        return str(v.date())
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return repr(round(float(v), 9))
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


def test_queries_without_sql_have_other_tests():
    from tests import test_without_sql

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(test_without_sql.COVERED)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
