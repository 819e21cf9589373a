"""Profiles of columns with many values."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators.profile import column_profile, least_values, wide_profile


def plain(df):
    return [tuple(r) for r in df.orderBy("ordinal").collect()]


def test_wide_profiles_are_those_of_combinations(spark):
    rows = [(i % 3, f"v{i % 7}", None if i % 5 else f"ü{i}", float("nan") if i % 2 else i / 4) for i in range(60)]
    df = spark.createDataFrame(rows + [(None, None, None, None)] * 3, "a int, `b c` string, d string, e double")
    names = ["e", "a", "absent", "b c", "d"]
    for examples in (1, 4, 100):
        assert plain(wide_profile(df, names, examples)) == plain(column_profile(df, names, examples))
    for empty in (df.where("false"), df.where("a is null")):
        found = plain(wide_profile(empty, names))
        assert [(r[1], r[2], r[4], r[5]) for r in found] == [(n, n == "absent", 0, None) for n in names]
        assert {r[3] for r in found} == {empty.count()}
    assert plain(wide_profile(df, [])) == [] and plain(wide_profile(df, ["absent"]))[0][2:] == (True, 63, 0, None)


@pytest.mark.parametrize("tasks", [1, 6])
def test_few_rows_move_for_examples(spark, tasks):
    df = spark.range(0, 50_000, 1, tasks).select(
        F.sha2(F.col("id").cast("string"), 256).alias("c0"), F.lit("same").alias("c1"), F.lit(None).cast("string").alias("c2")
    )
    least = least_values(df, [0, 1, 2], 5)
    assert least.count() <= tasks * (5 + 1)
    wanted = [r[0] for r in df.select("c0").orderBy("c0").limit(5).collect()]
    found = wide_profile(df.toDF("x", "y", "z"), ["x", "y", "z"], 5).orderBy("ordinal").collect()
    assert found[0]["examples"] == wanted and found[0]["distinct_values"] == 50_000
    assert found[1]["examples"] == ["same"] and found[2]["examples"] is None
    plan = wide_profile(df, ["c0"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    # With a single task there is nothing to shuffle.
    assert tasks == 1 or any("one" in line and "two" in line for line in exchanges)
    assert not any("c0" in line for line in exchanges)
