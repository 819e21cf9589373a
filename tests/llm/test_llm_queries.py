"""Every query of the training-data operators that has SQL, against it."""

import glob
import os

import duckdb
import pytest

from tracemill.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    wanted = tables.execute(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert sorted(found[columns].astype(str).values.tolist()) == sorted(
        wanted[columns].astype(str).values.tolist()
    )


def test_registered(spark):
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
