import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import curves
from tracemill.operators.curves import (
    density,
    duration_curve,
    duration_curve_frame,
    first_technology,
    line,
    stacked_area,
)

SCHEMA = "trace_id int, value double"


def frame(spark, values, schema=SCHEMA):
    return spark.createDataFrame(values, schema)


def test_duration_curve_counts_nulls_last(spark):
    rows = [(0, 3.0), (0, None), (0, 5.0), (0, 3.0), (1, 2.0)]
    found = duration_curve(frame(spark, rows)).orderBy("trace_id", "rank").collect()
    assert [tuple(row) for row in found] == [
        (0, 1, 25.0, 5.0),
        (0, 2, 50.0, 3.0),
        (0, 3, 75.0, 3.0),
        (0, 4, 100.0, None),
        (1, 1, 100.0, 2.0),
    ]


def test_duration_frame_leaves_out_what_is_no_number(spark):
    rows = [("a", "3"), ("a", "x"), ("a", None), ("a", "nan"), ("a", "10"), ("b", "x")]
    df = frame(spark, rows, "series string, v string")
    found = duration_curve_frame(df, "series", "v").orderBy("rank").collect()
    assert [tuple(row) for row in found] == [("a", 10.0, 1, 50.0), ("a", 3.0, 2, 100.0)]


def brute_force_curve(rows):
    expected = []
    for series in {s for s, _ in rows}:
        values = sorted((v for s, v in rows if s == series), reverse=True)
        for rank, value in enumerate(values, start=1):
            expected.append((series, rank, rank / len(values) * 100.0, value))
    return sorted(expected)


@pytest.mark.parametrize("copies_per_row", [10_000, 7, 2])
def test_skewed_series_and_values(spark, monkeypatch, copies_per_row):
    """One series has most rows, and one value a third of them."""
    monkeypatch.setattr(curves, "COPIES_PER_ROW", copies_per_row)
    rng = random.Random(7)
    rows = [(0, 0.0)] * 3000
    rows += [(0, float(rng.randrange(2000))) for _ in range(5000)]
    rows += [(i, rng.random()) for i in range(1, 50) for _ in range(i)]
    rng.shuffle(rows)
    found = duration_curve(frame(spark, rows).repartition(8))
    assert sorted(tuple(row) for row in found.collect()) == brute_force_curve(rows)


def test_large_series_is_spread_over_ranges(spark):
    df = spark.range(50_000).select(F.lit(0).alias("s"), F.rand(3).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = curves.value_ranges(df)
        sizes = [row["count"] for row in ranges.groupBy("range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 50_000
    assert len(sizes) == 8 and max(sizes) < 4 * min(sizes)


def test_any_column_names(spark):
    df = frame(spark, [("a", 2.0), ("a", 1.0)], "`range` string, `copies per day` double")
    found = duration_curve_frame(df, "range", "copies per day").orderBy("rank").collect()
    assert [tuple(row) for row in found] == [("a", 2.0, 1, 50.0), ("a", 1.0, 2, 100.0)]
    assert density(df, "range", "copies per day").where("y > 0").count() == 2


def numpy_density(values):
    bins = 100 if len(values) >= 100 else max(10, len(values))
    heights, edges = np.histogram(values, bins=bins, density=True)
    return list((edges[:-1] + edges[1:]) / 2.0), list(heights)


@pytest.mark.parametrize(
    "values",
    [
        [float(i) for i in range(1, 51)] * 7,
        [i / 10 for i in range(1000)],
        [i * 0.1 for i in range(-50, 51)],
        [1.0, 2.0, 2.0, 9.0],
        [4.25],
        [-3.0] * 150,
        [0.0, 1e-9, 1e9],
        [random.Random(5).gauss(0, 1) for _ in range(997)],
    ],
)
def test_density_equals_numpy(spark, values):
    rows = [(0, v) for v in values] + [(0, None), (0, math.nan), (0, math.inf), (1, None)]
    found = density(frame(spark, rows)).orderBy("bin").collect()
    x, y = numpy_density(values)
    assert {row["trace_id"] for row in found} == {0}
    assert [row["bin"] for row in found] == list(range(len(x)))
    np.testing.assert_allclose([row["x"] for row in found], x, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose([row["y"] for row in found], y, rtol=1e-9)


def test_density_has_area_one(spark):
    rng = random.Random(11)
    rows = [(i % 3, rng.lognormvariate(0, 2)) for i in range(2000)]
    found = density(frame(spark, rows)).toPandas().sort_values(["trace_id", "bin"])
    for _, group in found.groupby("trace_id"):
        width = np.diff(group["x"]).mean()
        assert math.isclose((group["y"] * width).sum(), 1.0, rel_tol=1e-9)


def test_stacked_area(spark):
    t0 = datetime(2024, 1, 1)
    t1 = t0 + timedelta(hours=1)
    rows = [(0, t0, 1.0), (2, t0, 4.0), (2, t0, 1.0), (0, t1, None), (1, t1, -2.0)]
    df = frame(spark, rows, "trace_id int, time timestamp_ntz, value double")
    found = stacked_area(df, range(5)).orderBy("time", "trace_id").collect()
    assert [tuple(row) for row in found] == [
        (0, t0, 1.0, 0.0, 1.0),
        (1, t0, 0.0, 1.0, 1.0),
        (2, t0, 5.0, 1.0, 6.0),
        (0, t1, 0.0, 0.0, 0.0),
        (1, t1, -2.0, 0.0, -2.0),
        (2, t1, 0.0, -2.0, -2.0),
    ]


def test_infinite_values_are_layers(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(0, t0, 1.0), (1, t0, -math.inf), (2, t0, 3.0)]
    df = frame(spark, rows, "trace_id int, time timestamp_ntz, value double")
    found = stacked_area(df, range(3)).orderBy("trace_id").collect()
    assert [(row["trace_id"], row["value"], row["y1"]) for row in found] == [
        (0, 1.0, 1.0), (1, -math.inf, -math.inf), (2, 3.0, -math.inf)
    ]


def test_many_sparse_traces_are_filled(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i % 50), float(i)) for i in range(1000)]
    df = frame(spark, rows, "trace_id int, time timestamp_ntz, value double")
    found = stacked_area(df, range(2000))
    assert found.count() == 50 * 1000
    top = found.where("trace_id = 999").orderBy("time").collect()
    assert [row["y1"] for row in top] == [sum(range(h, 1000, 50)) for h in range(50)]
    assert stacked_area(df.limit(0), range(3)).count() == 0


def test_curves_leave_out_a_series_without_a_name(spark):
    rows = [(None, 1.0), (None, 2.0), (1, 3.0), (1, 4.0)]
    for curve in (duration_curve, density):
        found = curve(frame(spark, rows)).select("trace_id").distinct().collect()
        assert [row[0] for row in found] == [1]


def test_top_of_the_stack_is_the_total(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(hours=rng.randrange(50)), float(rng.randrange(100)))
        for i in range(4)
        for _ in range(60)
    ]
    df = frame(spark, rows, "trace_id int, time timestamp_ntz, value double")
    stacked = stacked_area(df, range(4)).toPandas()
    top = stacked[stacked["trace_id"] == 3].set_index("time")["y1"].sort_index()
    total = pd.DataFrame(rows, columns=["i", "time", "v"]).groupby("time")["v"].sum()
    assert list(top) == list(total.sort_index())


def test_line_is_ordered(spark):
    start = datetime(2024, 1, 1)
    rows = [(i % 2, start - timedelta(hours=i)) for i in range(20)]
    found = line(frame(spark, rows, "trace_id int, time timestamp_ntz")).collect()
    assert [tuple(row) for row in found] == sorted(rows)


def test_first_technology(spark):
    rows = [("a", None, 1), ("a", "Gas", 3), ("a", "Coal", 2), ("b", None, 1)]
    df = frame(spark, rows, "s string, t string, o int")
    assert [tuple(r) for r in first_technology(df, "s", "t", "o").collect()] == [("a", "Coal")]
