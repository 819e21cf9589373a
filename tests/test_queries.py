"""Every query against its SQL, on the test tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).itertuples(index=False, name=None)
    found = [tuple(plain(value) for value in row) for row in values]
    return columns, sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert rows(found) == rows(tables.execute(ORACLES[name]).df())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
