from datetime import datetime

from pyspark.sql import functions as F

from tracemill.functions.labels import CLUSTERS, normalized_technology, series_label, technology_clusters
from tracemill.functions.values import to_number
from tracemill.operators.clean import strip_names, with_number
from tracemill.operators.rollup import collapse_units, rollup_cluster, rollup_technology

NAN = float("nan")
T0 = datetime(2024, 1, 1)
SCHEMA = (
    "Datetime timestamp_ntz, hour int, `__run_key` string, `__source_file` string, BZ string,"
    " WS int, Sample string, Property string, PEMMDB_TECHNOLOGY string, `Unit Name` string,"
    " note string, Value double, Cost bigint"
)
ROWS = [
    (T0, 0, "r1", "f", "DE", 1, None, "gen", "Gas", "a", "x", 1.0, 1),
    (T0, 0, "r1", "g", "DE", 1, None, "gen", "Gas", "b", "y", NAN, 2),
    (T0, 0, "r2", "f", "DE", 1, None, "gen", "Gas", "a", "x", 4.0, None),
    (T0, 0, "r1", "f", "DE", 1, None, "load", None, None, "x", None, None),
    (T0, 0, "r1", "f", "DE", 1, None, "load", None, None, "x", NAN, None),
]


def facts(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_rollup_keeps_runs_and_null_technologies(spark):
    found = rollup_technology(facts(spark))
    assert found.columns == [
        "__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "Sample", "WS", "Datetime", "hour",
        "Value", "Cost",
    ]
    rows = {(r["__run_key"], r["PEMMDB_TECHNOLOGY"]): (r["Value"], r["Cost"]) for r in found.collect()}
    assert rows == {("r1", "Gas"): (1.0, 3), ("r2", "Gas"): (4.0, 0), ("r1", None): (0.0, 0)}


def test_rollup_without_technology_or_measure_changes_nothing(spark):
    df = facts(spark)
    assert rollup_technology(df.drop("PEMMDB_TECHNOLOGY")).count() == len(ROWS)
    assert rollup_technology(df.drop("Value", "Cost")).count() == len(ROWS)
    assert collapse_units(df.drop("Unit Name")).count() == len(ROWS)


def test_collapse_units_keeps_dimensions(spark):
    # The scenario is a number, and stays a key; texts stay keys as well.
    found = collapse_units(facts(spark).drop("hour"))
    assert "WS" in found.columns and "Unit Name" not in found.columns
    rows = sorted((r["__run_key"], r["note"], r["WS"], r["Value"]) for r in found.collect())
    assert rows == [("r1", "x", 1, 0.0), ("r1", "x", 1, 1.0), ("r1", "y", 1, 0.0), ("r2", "x", 1, 4.0)]


def test_rolled_up_total_is_the_total(spark):
    df = spark.range(1000).select(
        F.lit("r").alias("__run_key"),
        (F.col("id") % 7).cast("string").alias("PEMMDB_TECHNOLOGY"),
        F.col("id").cast("double").alias("Value"),
    )
    assert rollup_technology(df).agg(F.sum("Value")).first()[0] == sum(range(1000))


def test_normalized_names(spark):
    names = ["Hard coal/New", "hard_coal-new", "  Hard   COAL / new ", "OtherNon-RES", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = [row[0] for row in df.select(normalized_technology(F.col("n"))).collect()]
    assert found == ["hard coal new"] * 3 + ["othernon res", None]


def test_clusters(spark):
    names = [(alias, cluster) for cluster, aliases in CLUSTERS.items() for alias in [cluster, *aliases]]
    names += [("unknown", None), (None, None)]
    df = spark.createDataFrame(names, "tech string, expected string")
    found = technology_clusters(df, "tech").collect()
    assert len(found) == len(names)
    assert all(row["cluster"] == row["expected"] for row in found)
    assert len(CLUSTERS) == 22


def test_rollup_to_clusters(spark):
    rows = [("r", "Gas/OCGT new", T0, 1.0), ("r", "gas_ccgt-new", T0, 2.0), ("r", "Wind offshore", T0, 4.0)]
    df = spark.createDataFrame(
        rows, "`__run_key` string, PEMMDB_TECHNOLOGY string, Datetime timestamp_ntz, Value double"
    )
    found = rollup_cluster(technology_clusters(df, "PEMMDB_TECHNOLOGY"), "cluster").collect()
    assert {row["cluster"]: row["Value"] for row in found} == {"Gas": 3.0, "Wind": 4.0}


def test_series_label(spark):
    df = spark.createDataFrame([("f", None, 1)], "`__source_file` string, `__dispatch_component` string, n int")
    row = df.select(
        series_label(["__source_file", "__dispatch_component", "n"]), series_label(["n"]), series_label([])
    ).first()
    assert tuple(row) == ("File=f | Dispatch=NA | n=1", "n=1", "Gesamt")


def test_numbers_in_texts(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "7.", "inf", "-Infinity", "nan", "5d", "5f", "0x10", "", "1,5", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    found = [row[0] for row in df.select(to_number(F.col("v"), df.schema["v"].dataType)).collect()]
    inf = float("inf")
    assert found == [1.0, 2.5, -300.0, 0.5, 7.0, inf, -inf] + [None] * 7
    assert with_number(df, "v").count() == 7


def test_strip_names_merges_equal_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, 2, "y")], "` a ` int, a int, `b ` string")
    found = strip_names(df)
    assert found.columns == ["a", "b"]
    assert [tuple(row) for row in found.collect()] == [(1, "x"), (2, "y")]
