from pyspark.sql import functions as F

from tracemill.operators.profile import column_profile, schema_profile
from tracemill.operators.selector import (
    keep_known,
    leaf_properties,
    leaf_technologies,
    membership_filter,
    options_by_label,
    options_by_value,
    selector_index,
    selector_tree,
    series_order,
    tree_leaf,
    unit_options,
)

SCHEMA = (
    "`__run_key` string, WS double, BZ string, Property string,"
    " PEMMDB_TECHNOLOGY string, `Unit Name` string, Value double"
)
NAN = float("nan")
ROWS = [
    ("r1", 1.0, "DE", "load", None, None, 1.0),
    ("r1", 1.0, "DE", "load", None, None, 2.0),
    ("r1", 1.0, "DE", "gen", "Gas", "u2", 1.0),
    ("r1", 1.0, "DE", "gen", "Gas", "u10", 1.0),
    ("r1", 1.0, "DE", "gen", "Coal", " ", 1.0),
    ("r1", 1.0, "DE", "gen", "  ", "u1", 1.0),
    ("r1", 1.0, "FR", " ", "Gas", None, 1.0),
    ("r1", NAN, "FR", "load", None, None, 1.0),
    ("r2", None, "FR", "load", None, None, 1.0),
    (None, 1.0, "FR", "load", None, None, 1.0),
    ("r2", 2.0, "FR", "gen", "Wind", "w", 1.0),
]


def facts(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def tree(spark):
    return selector_tree(selector_index(facts(spark)))


def test_index_is_distinct(spark):
    index = selector_index(facts(spark))
    assert "Value" not in index.columns
    assert index.count() == len(ROWS) - 1


def test_tree(spark):
    found = {tuple(row) for row in tree(spark).collect()}
    assert found == {
        ("r1", 1.0, "DE", "load", None),
        ("r1", 1.0, "DE", "gen", "Gas"),
        ("r1", 1.0, "DE", "gen", "Coal"),
        ("r1", 1.0, "DE", "gen", None),  # the blank technology
        ("r1", 1.0, "FR", None, None),  # a leaf with nothing to choose
        ("r2", 2.0, "FR", "gen", "Wind"),
    }


def test_tree_needs_run_area_and_scenario(spark):
    assert selector_tree(selector_index(facts(spark).drop("WS"))).count() == 0
    assert selector_index(facts(spark).select("Value")).count() == 0


def test_leaf(spark):
    leaf = tree_leaf(tree(spark), "r1", "1", "DE")
    assert {tuple(r) for r in leaf_properties(leaf).collect()} == {("load", False), ("gen", True)}
    names = leaf_technologies(leaf, "gen").collect()
    assert {row["technology"] for row in names} == {"Gas", "Coal"}
    assert leaf_technologies(leaf, "load").count() == 0
    assert tree_leaf(tree(spark), "r1", 1, "FR").count() == 0
    assert tree_leaf(tree(spark), "r9", 1, "DE").count() == 0


def units(spark, *choice):
    found = unit_options(selector_index(facts(spark)), *choice).orderBy("rank").collect()
    return [row["value"] for row in found]


def test_units(spark):
    assert units(spark, "r1", "1.0", "DE", "gen", "Gas") == ["u10", "u2"]
    assert units(spark, None, None, None, "gen", None) == ["u1", "u10", "u2", "w"]
    assert units(spark, "r1", 1, "DE", None, None) == []
    assert units(spark, "r1", "x", "DE", "gen", "Gas") == []


def test_options_are_whole_unless_cut(spark):
    numbers = spark.range(1, 1001).select("id").union(spark.range(1, 11))
    by_label = options_by_label(numbers, "id").orderBy("rank").collect()
    assert [row["rank"] for row in by_label] == list(range(1, 1001))
    assert [row["value"] for row in by_label[:4]] == [1, 10, 100, 1000]
    assert [row["label"] for row in by_label] == sorted(map(str, range(1, 1001)))
    cut = options_by_label(numbers, "id", 500).orderBy("rank").collect()
    assert cut == by_label[:500]
    by_value = options_by_value(numbers, "id", 3).orderBy("rank").collect()
    assert [tuple(row) for row in by_value] == [(1, 1, "1"), (2, 2, "2"), (3, 3, "3")]
    nothing = spark.createDataFrame([(None,), (NAN,)], "v double")
    assert options_by_value(nothing, "v").count() == 0


def test_membership_filter(spark):
    df = facts(spark)
    assert membership_filter(df, "BZ", ["DE"]).count() == 6
    assert membership_filter(df, "BZ", []).count() == len(ROWS)
    assert membership_filter(df, "absent", ["DE"]).count() == len(ROWS)


def test_keep_known():
    assert keep_known(["a", "b", "c"], ["c", "x", "a"]) == ["a", "c"]
    assert keep_known(["a", "b"], ["x"]) == ["a", "b"]
    assert keep_known(["a", "b"], None) == ["a", "b"]


def test_series_order_ignores_case(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), (None,), ("C",), ("b",)], "s string")
    assert [row["label"] for row in series_order(df, "s").collect()] == ["A", "a", "b", "C"]


def test_column_profile(spark):
    found = column_profile(facts(spark), ["BZ", "absent", "PEMMDB_TECHNOLOGY"])
    rows = [tuple(row) for row in found.orderBy("ordinal").collect()]
    assert rows == [
        (0, "BZ", False, 11, 2, ["DE", "FR"]),
        (1, "absent", True, 11, 0, None),
        (2, "PEMMDB_TECHNOLOGY", False, 11, 4, ["  ", "Coal", "Gas", "Wind"]),
    ]
    many = spark.range(100).select(F.col("id").alias("BZ"))
    row = column_profile(many, ["BZ"]).first()
    assert row["distinct_values"] == 100
    assert row["examples"] == sorted(map(str, range(100)))[:10]


def test_schema_profile(spark):
    df = spark.createDataFrame(
        [], "Datetime string, hour int, Value double, cost decimal(10,2), list array<float>, x string"
    )
    rows = schema_profile(df).orderBy("ordinal").collect()
    assert [(r["column"], r["is_time"], r["is_numeric"]) for r in rows] == [
        ("Datetime", True, False),
        ("hour", True, True),
        ("Value", False, True),
        ("cost", False, True),
        ("list", False, False),
        ("x", False, False),
    ]
