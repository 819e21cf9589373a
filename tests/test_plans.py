"""What Spark is asked to do: scans, filters, joins and shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.facts import event_facts
from tracemill.operators.clean import fact_table
from tracemill.operators.curves import density, stacked_area
from tracemill.operators.joins import spread_join
from tracemill.operators.profile import column_profile
from tracemill.operators.rollup import rollup_technology
from tracemill.operators.selector import options_by_label, selector_index
from tracemill.plans.evaluate import evaluate, with_steps
from tracemill.plans.traces import TraceSpec
from tracemill.plans.visualize import MODES, load_facts, visualize

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def final_plan_of(df):
    df.collect()
    return plan_of(df).split("== Initial Plan")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Facts as a parquet file with the columns of real inputs, and more."""
    path = str(tmp_path_factory.mktemp("facts") / "facts.parquet")
    extra = event_facts(spark, FOLDER).withColumn("Comment", F.lit("unused"))
    extra.write.parquet(path)
    return path


def facts(spark, stored):
    return fact_table(spark.read.parquet(stored))


SPECS = [
    TraceSpec("run_0", 0, "click", "generation", None, None, "sum", "hour"),
    TraceSpec("run_0", 0, "click", "generation", None, None, "mean", "day"),
    TraceSpec("run_1", 3, "view", "load", None, None, "max", "week"),
]


def test_many_traces_are_one_scan(spark, stored):
    plan = plan_of(evaluate(facts(spark, stored), SPECS).points)
    assert plan.count("FileScan parquet") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_sums_are_shuffled_once(spark, stored):
    sums = [SPECS[0], TraceSpec("run_1", 3, "view", "load", None, None, "sum", "week")]
    plan = plan_of(evaluate(facts(spark, stored), sums).points)
    assert plan.count("Exchange hashpartitioning") == 1
    mixed = plan_of(evaluate(facts(spark, stored), SPECS).points)
    assert mixed.count("Exchange hashpartitioning") == 2


def test_the_raw_limit_reads_the_facts_once(spark, stored):
    raw = [
        TraceSpec(None, 0, "click", None, None, None, "none"),
        TraceSpec("run_0", 0, "click", "load", None, None, "none"),
    ]
    whole = evaluate(facts(spark, stored), raw, raw_limit=None).points
    small, large = sorted(row["count"] for row in whole.groupBy("trace_id").count().collect())
    limited = evaluate(facts(spark, stored), raw, raw_limit=small).points
    assert small < large and limited.count() == small
    assert "FileScan" not in final_plan_of(limited)  # the points were written
    assert "FileScan" in final_plan_of(whole)


def test_filters_and_columns_reach_the_scan(spark, stored):
    points = evaluate(facts(spark, stored), SPECS, start="2024-01-03", end="2024-01-09").points
    plan = formatted_plan_of(points)
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    for part in ("In(BZ, [click,view])", "GreaterThanOrEqual(Datetime", "LessThan(Datetime"):
        assert part in pushed, pushed
    assert "In(__run_key, [run_0,run_1])" in pushed and "In(WS, [0.0,3.0])" in pushed
    read = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "Comment" not in read and "Unit Name" not in read


def test_traces_of_one_run_are_one_equality(spark, stored):
    plan = formatted_plan_of(evaluate(facts(spark, stored), SPECS[:2]).points)
    assert "EqualTo(__run_key,run_0)" in plan


def test_rollup_shuffles_once_after_partial_sums(spark, stored):
    plan = plan_of(rollup_technology(facts(spark, stored), time_columns=["Datetime"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan


def test_index_is_distinct_before_the_shuffle(spark, stored):
    plan = plan_of(selector_index(facts(spark, stored)))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "Value" not in plan.split("ReadSchema:")[1]


def test_options_are_ranked_over_all_ranges(spark, stored):
    values = facts(spark, stored).select(F.col("Unit Name").alias("value"))
    assert options_by_label(values, "value", 3).count() == 3
    whole = options_by_label(values, "value").orderBy("rank").collect()
    assert [row["rank"] for row in whole] == list(range(1, len(whole) + 1))
    labels = [row["label"] for row in whole]
    assert labels == sorted(labels) and len(labels) == values.dropna().distinct().count()


def test_examples_are_cut_before_the_shuffle(spark, stored):
    plan = final_plan_of(column_profile(facts(spark, stored), ["BZ", "Unit Name"]))
    assert "WindowGroupLimit" in plan
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_density_and_stack_read_the_facts_once_more_at_most(spark, stored):
    points = with_steps(evaluate(facts(spark, stored), SPECS).points)
    assert final_plan_of(density(points)).count("FileScan parquet") == 1
    assert "FileScan" not in final_plan_of(stacked_area(points, range(3)))


def test_density_of_a_nullable_series_shuffles_no_values(spark, stored):
    rows = spark.read.parquet(stored).withColumn("s", F.nullif("BZ", F.lit("click")))
    curve = density(rows, "s", "Value")
    plan = final_plan_of(curve)
    assert plan.count("FileScan parquet") == 1  # and one for the ranges, before
    assert not re.search(r"hashpartitioning\([^)]*\bv#", plan)
    areas = curve.groupBy("s").agg(F.sum("y").alias("y"), F.max("x").alias("a"), F.min("x").alias("b"), F.count("*").alias("n"))
    for row in areas.collect():
        assert row["s"] is not None
        assert row["y"] * (row["a"] - row["b"]) / (row["n"] - 1) == pytest.approx(1)


def test_long_lists_of_raw_traces_split_a_hot_selection(spark, stored, monkeypatch):
    from tracemill.operators import joins

    specs = [TraceSpec(None, 0, "click", aggregation="none") for _ in range(3)]
    short = evaluate(facts(spark, stored), specs).points.groupBy("trace_id").count().collect()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    long = evaluate(facts(spark, stored), specs).points
    assert "__copy" in plan_of(long)
    assert sorted(long.groupBy("trace_id").count().collect()) == sorted(short)


def test_raw_traces_are_whole_by_default(spark):
    rows = spark.range(300_001).select(
        F.lit("2024-01-01 00.00").alias("Datetime"),
        F.col("id").cast("double").alias("Value"),
        F.lit("r").alias("__run_key"),
        F.lit(1).alias("WS"),
        F.lit("DE").alias("BZ"),
    )
    spec = TraceSpec("r", 1, "DE", aggregation="none")
    assert evaluate(fact_table(rows), [spec]).points.count() == 300_001
    assert evaluate(fact_table(rows), [spec], raw_limit=300_000).points.count() == 0


def test_a_run_or_scenario_that_the_facts_cannot_tell_is_an_error(spark, stored):
    rows = facts(spark, stored).drop("__run_key")
    with pytest.raises(ValueError, match="__run_key"):
        evaluate(rows, [TraceSpec("run_0", 0, "click")])
    with pytest.raises(ValueError, match="scenarios"):
        evaluate(rows, [TraceSpec(None, 0, "click", scenario="a/b.parquet")]).points.count()
    named = rows.withColumn("Scenario", F.lit("one"))
    found = evaluate(named, [TraceSpec("run_0", 0, "click", scenario="two")]).points
    assert found.count() == 0
    found = evaluate(named, [TraceSpec("run_0", 0, "click", scenario="one")]).points
    assert found.count() > 0


def test_spread_join_splits_a_hot_key(spark):
    rows = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = spread_join(rows, lookup, ["k"], ["v"])
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(row["count"] for row in sizes) == 10_000
    assert len(sizes) > 3 and max(row["count"] for row in sizes) < 5_000


@pytest.mark.parametrize("mode", MODES)
def test_plots(spark, stored, mode):
    plot = visualize(facts(spark, stored), SPECS, mode)
    assert plot.data.count() > 0
    assert [row["status"] for row in plot.report.orderBy("trace_id").collect()] == ["ok"] * 3


def test_unknown_plot(spark, stored):
    with pytest.raises(ValueError):
        visualize(facts(spark, stored), SPECS, "pie")


def test_only_named_runs_are_read(spark, stored, tmp_path):
    rows = spark.read.parquet(stored)
    for run in ("run_0", "run_1"):
        rows.where(F.col("__run_key") == run).drop("__run_key").write.parquet(f"{tmp_path}/{run}")
    loaded = load_facts(spark, str(tmp_path), SPECS[:2], unit_detail=True)
    assert {row[0] for row in loaded.select("__run_key").distinct().collect()} == {"run_0"}
    assert "Comment" not in loaded.columns
    everything = load_facts(spark, str(tmp_path), [TraceSpec(None, 0, "click")])
    assert everything.select("__run_key").distinct().count() == 2
    path = loaded.first()["__source_file"].replace("file:///", "file:/")
    one = load_facts(spark, str(tmp_path), [TraceSpec(None, 0, "click", scenario=path)])
    assert one.select("__source_file").distinct().count() == 1
