from datetime import datetime

import pytest

from tracemill.operators import joins
from tracemill.operators.clean import fact_table
from tracemill.operators.selector import selector_index, selector_tree
from tracemill.plans.evaluate import evaluate, report, summary, with_steps
from tracemill.plans.traces import (
    TraceSpec,
    first_of_label,
    specs_frame,
    trace_label,
    validate,
    with_defaults,
    without_labels,
)

SCHEMA = (
    "Datetime string, Value double, `__run_key` string, WS {ws}, BZ string, Property string,"
    " PEMMDB_TECHNOLOGY string, `Unit Name` string"
)
STRUCT = ", ".join(
    f"{name}: {kind}"
    for name, kind in (
        ("Datetime", "string"),
        ("Value", "double"),
        ("`__run_key`", "string"),
        ("WS", "int"),
        ("BZ", "string"),
        ("Property", "string"),
        ("PEMMDB_TECHNOLOGY", "string"),
        ("`Unit Name`", "string"),
    )
)
NAN = float("nan")
ROWS = [
    # Two gas units, two hours of one day, one hour of the next.
    ("2024-01-01 10.00", 1.0, "r1", 4, "DE", "gen", "Gas", "a"),
    ("2024-01-01 10.00", 2.0, "r1", 4, "DE", "gen", "Gas", "b"),
    ("2024-01-01 11.00", 5.0, "r1", 4, "DE", "gen", "Gas", "a"),
    ("2024-01-01 11.00", NAN, "r1", 4, "DE", "gen", "Gas", "b"),
    ("2024-01-02 00.00", 7.0, "r1", 4, "DE", "gen", "Gas", "a"),
    # Only nulls.
    ("2024-01-01 10.00", None, "r1", 4, "FR", "gen", "Coal", "c"),
    ("2024-01-01 11.00", NAN, "r1", 4, "FR", "gen", "Coal", "c"),
    # A property without technology, in two runs and scenarios.
    ("2024-01-01 10.00", 10.0, "r1", 4, "DE", "load", None, None),
    ("2024-01-01 10.00", 20.0, "r2", 4, "DE", "load", None, None),
    ("2024-01-01 10.00", 30.0, "r1", 1, "DE", "load", None, None),
]


def facts(spark, ws="int"):
    change = {"string": str, "double": float}.get(ws, int)
    rows = [(*row[:3], change(row[3]), *row[4:]) for row in ROWS]
    return fact_table(spark.createDataFrame(rows, SCHEMA.format(ws=ws)))


def points(spark, *specs, ws="int", **options):
    found = evaluate(facts(spark, ws), specs, **options).points
    return [(r["trace_id"], r["time"], r["value"]) for r in found.orderBy("trace_id", "time").collect()]


TEN, ELEVEN = datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11)
FIRST, SECOND = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_daily_mean_is_the_mean_of_technology_totals(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", None, "mean", "day")
    assert points(spark, spec) == [(0, FIRST, 4.0), (0, SECOND, 7.0)]
    # Of units: the mean of 1, 2 and 5; the NaN does not count.
    assert points(spark, spec, unit_detail=True) == [(0, FIRST, 8 / 3), (0, SECOND, 7.0)]


def test_sum_of_nulls_is_zero_and_other_aggregates_are_null(spark):
    specs = [
        TraceSpec("r1", 4, "FR", "gen", "Coal", "c", how, "day")
        for how in ("sum", "mean", "min", "max")
    ]
    found = points(spark, *specs, unit_detail=True)
    assert [value for _, _, value in found] == [0.0, None, None, None]
    # Rolled up first, the totals are 0 and no longer null.
    assert [value for _, _, value in points(spark, *specs)] == [0.0, 0.0, 0.0, 0.0]


def test_other_time_columns_keep_rows_apart(spark):
    late = fact_table(
        spark.createDataFrame(
            [(row, i % 2) for i, row in enumerate(ROWS)], f"row struct<{STRUCT}>, delivery_hour int"
        ).select("row.*", "delivery_hour")
    )
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", None, "mean", "day")

    def first_day(**options):
        return evaluate(late, [spec], **options).points.orderBy("time").first()["value"]

    assert first_day() == (1.0 + 2.0 + 5.0 + 0.0) / 4
    assert first_day(time_columns=[]) == (3.0 + 5.0) / 2


def test_a_unit_can_only_be_picked_in_unit_detail(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", "b", "sum", "day")
    assert points(spark, spec) == [(0, FIRST, 8.0), (0, SECOND, 7.0)]
    assert points(spark, spec, unit_detail=True) == [(0, FIRST, 2.0)]


@pytest.mark.parametrize("ws", ["int", "double", "string"])
def test_scenarios_are_equal_as_numbers(spark, ws):
    specs = [TraceSpec("r1", value, "DE", "load") for value in (4, 4.0, "4", "4.0", "x")]
    found = points(spark, *specs, ws=ws)
    assert found == [(i, TEN, 10.0) for i in range(4)]


def test_scenarios_that_are_no_numbers_are_equal_as_texts(spark):
    rows = [(*row[:3], "dry" if row[3] == 4 else "wet", *row[4:]) for row in ROWS]
    table = fact_table(spark.createDataFrame(rows, SCHEMA.format(ws="string")))
    found = evaluate(table, [TraceSpec("r1", "dry", "DE", "load")]).points.collect()
    assert [row["value"] for row in found] == [10.0]


def test_runs_are_kept_apart_and_none_does_not_filter(spark):
    assert points(spark, TraceSpec("r2", 4, "DE", "load")) == [(0, TEN, 20.0)]
    assert points(spark, TraceSpec(None, 4, "DE", "load")) == [(0, TEN, 30.0)]
    assert points(spark, TraceSpec("r1", 4, "DE"))[0] == (0, TEN, 13.0)


def test_unknown_function_sums_and_unknown_bucket_keeps_time(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", None, "median", "quarter")
    assert points(spark, spec) == [(0, TEN, 3.0), (0, ELEVEN, 5.0), (0, SECOND, 7.0)]


def test_raw_rows_ignore_the_bucket_and_keep_nulls(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", "b", "none", "day")
    assert points(spark, spec, unit_detail=True) == [(0, TEN, 2.0), (0, ELEVEN, None)]


def test_technology_trace_names_it_in_the_property(spark):
    spec = TraceSpec("r1", 4, "DE", "Gas", None, None, "sum", "day", is_technology=True)
    assert points(spark, spec) == [(0, FIRST, 8.0), (0, SECOND, 7.0)]


def test_date_range(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas")
    assert points(spark, spec, end="2024-01-01") == [(0, TEN, 3.0), (0, ELEVEN, 5.0)]
    assert points(spark, spec, start="2024-01-02") == [(0, SECOND, 7.0)]


def test_two_points_per_bucket(spark):
    spec = TraceSpec("r1", 4, "DE", "gen", "Gas", None, "sum", "day")
    result = evaluate(facts(spark), [spec, TraceSpec("r1", 4, "DE", "load")])
    found = with_steps(result.points).orderBy("trace_id", "time").collect()
    assert [(r["trace_id"], r["time"], r["value"]) for r in found] == [
        (0, FIRST, 8.0),
        (0, datetime(2024, 1, 1, 23, 59, 59, 999999), 8.0),
        (0, SECOND, 7.0),
        (0, datetime(2024, 1, 2, 23, 59, 59, 999999), 7.0),
        (1, TEN, 10.0),
    ]


def test_a_large_raw_trace_is_refused_alone(spark):
    specs = [
        TraceSpec("r1", 4, "DE", "gen", "Gas", None, "none"),
        TraceSpec("r1", 4, "DE", "load", None, None, "none"),
        TraceSpec("r9", 4, "DE", "load"),
    ]
    result = evaluate(facts(spark), specs, raw_limit=2)
    reported = report(result, with_steps(result.points))
    found = {r["trace_id"]: (r["status"], r["points"]) for r in reported.collect()}
    assert found == {0: ("too_large", 0), 1: ("ok", 1), 2: ("missing", 0)}
    row = summary(reported).first()
    assert (row["traces"], row["points"]) == (3, 1)
    assert row["missing"] == ["r9 | WS 4 | DE | load"]
    whole = evaluate(facts(spark), specs, raw_limit=None)
    assert whole.points.where("trace_id = 0").count() == 3


def test_all_labels_without_data(spark):
    specs = [TraceSpec(f"r{i}", 4, "XX", "load") for i in range(7)]
    result = evaluate(facts(spark), specs)
    row = summary(report(result, result.points)).first()
    assert row["missing"] == [f"r{i} | WS 4 | XX | load" for i in range(7)]


def test_empty_trace_list(spark):
    assert evaluate(facts(spark), []).points.count() == 0


def test_long_trace_lists_are_joined_by_shuffle(spark, monkeypatch):
    specs = [
        TraceSpec("r1", 4, "DE", "gen", "Gas", None, "sum", "day"),
        TraceSpec("r1", 4, "DE", "load", None, None, "none"),
        TraceSpec(None, 4, "DE", "load"),
    ]
    short = points(spark, *specs)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        long = evaluate(facts(spark), specs).points
        assert "Broadcast" not in long._jdf.queryExecution().executedPlan().toString()
        found = long.orderBy("trace_id", "time").collect()
        assert [(r["trace_id"], r["time"], r["value"]) for r in found] == short
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


LABELS = [
    (TraceSpec("r1", 4, "DE", "gen", "Gas", "a", "sum", "day"), "r1 | WS 4 | DE | gen | Gas | a [sum/day]"),
    (TraceSpec("r1", 4.0, "DE", "load", None, None, "mean"), "r1 | WS 4.0 | DE | load [mean/native]"),
    (TraceSpec("r1", 4, "DE", "load", None, None, "none"), "r1 | WS 4 | DE | load [raw]"),
    (TraceSpec(None, 4, "DE", "load", scenario="f.parquet"), "f.parquet | WS 4 | DE | load"),
    (TraceSpec(None, 4, "DE"), "? | WS 4 | DE"),
    (TraceSpec("r1", 4, "DE", "Gas", is_technology=True), "r1 | WS 4 | DE | Gas"),
]


def test_labels(spark):
    found = specs_frame(spark, [spec for spec, _ in LABELS]).select(trace_label()).collect()
    assert [row[0] for row in found] == [label for _, label in LABELS]


def test_defaults_and_duplicates(spark):
    specs = [
        TraceSpec("r1", 4, "DE", "load"),
        TraceSpec("r1", 4, "DE", "load", None, None, "sum", "native"),
        TraceSpec("r1", 4, "DE", "load", None, None, "none", "week"),
    ]
    ready = with_defaults(specs_frame(spark, specs))
    assert [(r["aggregation"], r["resolution"]) for r in ready.orderBy("trace_id").collect()] == [
        ("sum", "native"),
        ("sum", "native"),
        ("none", "native"),
    ]
    kept = first_of_label(ready.withColumn("label", trace_label()))
    assert sorted(r["trace_id"] for r in kept.collect()) == [0, 2]
    left = without_labels(kept, ["r1 | WS 4 | DE | load [raw]"])
    assert [r["trace_id"] for r in left.collect()] == [0]


@pytest.mark.parametrize(
    "spec, plain, units",
    [
        (TraceSpec("r1", 4, "DE", "gen", "Gas"), None, "unit_required"),
        (TraceSpec("r1", "4.0", "DE", "gen", "Gas", "a"), "unit_not_allowed", None),
        (TraceSpec("r1", 4, "DE", "gen"), "technology_required", "technology_required"),
        (TraceSpec("r1", 4, "DE", "load", "Gas"), "technology_not_allowed", "technology_not_allowed"),
        (TraceSpec("r1", 4, "DE", "load"), None, "unit_needs_technology"),
        (TraceSpec("r1", None, "DE", "load"), "incomplete", "incomplete"),
        (TraceSpec("r1", 4, None, "load"), "incomplete", "incomplete"),
    ],
)
def test_validation(spark, spec, plain, units):
    tree = selector_tree(selector_index(facts(spark)))
    specs = specs_frame(spark, [spec])
    assert validate(specs, tree).first()["reason"] == plain
    assert validate(specs, tree, unit_detail=True).first()["reason"] == units
