"""The driver queries against their SQL at the smallest scale."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark import queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame):
    def shown(v):
        if pd.isna(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    found = rows(engine.QUERIES[name](spark, DATA).toPandas())
    assert found == rows(duck.execute(engine.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_names():
    assert set(engine.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
