from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracemill.functions.time import (
    bucket_end,
    bucket_end_by,
    bucket_start,
    bucket_start_by,
    within_dates,
)
from tracemill.operators.clean import UnknownTimes, fact_table, with_time
from tracemill.operators.profile import datetime_bounds, detect_time_columns


def times(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return rows.select(F.col("t").cast("timestamp_ntz").alias("t"))


def first(df):
    return [row[0] for row in df.collect()]


@pytest.mark.parametrize(
    "time, start",
    [
        ("2024-01-01 23:59:59", datetime(2023, 12, 26)),  # Monday, last day of its week
        ("2024-01-02 00:00:00", datetime(2024, 1, 2)),  # Tuesday, first day
        ("2024-01-08 12:00:00", datetime(2024, 1, 2)),
        ("2024-01-09 00:00:01", datetime(2024, 1, 9)),
        ("2023-12-31 10:00:00", datetime(2023, 12, 26)),
    ],
)
def test_week_starts_on_tuesday(spark, time, start):
    assert first(times(spark, time).select(bucket_start("t", "week"))) == [start]


@pytest.mark.parametrize(
    "resolution, start, end",
    [
        ("hour", datetime(2024, 2, 29, 13), datetime(2024, 2, 29, 13, 59, 59, 999999)),
        ("day", datetime(2024, 2, 29), datetime(2024, 2, 29, 23, 59, 59, 999999)),
        ("week", datetime(2024, 2, 27), datetime(2024, 3, 4, 23, 59, 59, 999999)),
        ("month", datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999999)),
        ("native", datetime(2024, 2, 29, 13, 45, 1), datetime(2024, 2, 29, 13, 45, 1)),
        ("quarter", datetime(2024, 2, 29, 13, 45, 1), datetime(2024, 2, 29, 13, 45, 1)),
    ],
)
def test_buckets(spark, resolution, start, end):
    begun = times(spark, "2024-02-29 13:45:01").select(bucket_start("t", resolution).alias("t"))
    assert first(begun) == [start]
    assert first(begun.select(bucket_end("t", resolution))) == [end]
    named = times(spark, "2024-02-29 13:45:01").withColumn("r", F.lit(resolution))
    begun = named.select("r", bucket_start_by("t", "r").alias("t"))
    assert first(begun.select("t")) == [start]
    assert first(begun.select(bucket_end_by("t", "r"))) == [end]


def test_december_ends_with_the_year(spark):
    begun = times(spark, "2024-12-05 00:00:00").select(bucket_start("t", "month").alias("t"))
    assert first(begun.select(bucket_end("t", "month"))) == [
        datetime(2024, 12, 31, 23, 59, 59, 999999)
    ]


def test_buckets_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        # 02:30 does not exist in this zone on this day.
        begun = times(spark, "2024-03-31 02:30:00").select(bucket_start("t", "hour").alias("t"))
        assert first(begun) == [datetime(2024, 3, 31, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_range_holds_the_whole_last_day(spark):
    rows = times(
        spark,
        "2024-01-01 23:59:59.999999",
        "2024-01-02 00:00:00",
        "2024-01-03 23:59:59.999999",
        "2024-01-04 00:00:00",
    )
    kept = rows.where(within_dates(F.col("t"), "2024-01-02", "2024-01-03"))
    assert first(kept) == [datetime(2024, 1, 2), datetime(2024, 1, 3, 23, 59, 59, 999999)]
    assert rows.where(within_dates(F.col("t"), "2024-01-04", None)).count() == 1
    assert rows.where(within_dates(F.col("t"), "no date", "")).count() == 4


def texts(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_hint_decides_at_eighty_percent(spark):
    hint = ["2024-01-01 10.30"] * 7 + ["2024-1-1 9.5"]
    iso = ["2024-01-01 11:30"]
    at_limit = with_time(texts(spark, hint + iso + [None]), "t")
    assert at_limit.where("t is not null").count() == 8
    assert datetime(2024, 1, 1, 9, 5) in first(at_limit)
    # One more misfit, and everything is read as ISO instead.
    below = with_time(texts(spark, hint + iso * 2 + [None]), "t")
    assert sorted(first(below.where("t is not null"))) == [datetime(2024, 1, 1, 11, 30)] * 2


def test_one_layout_for_the_whole_column(spark):
    days = with_time(texts(spark, ["13.01.2024 10:00", "01.02.2024", "02.02.2024 11:00:05"]), "t")
    assert first(days) == [
        datetime(2024, 1, 13, 10),
        datetime(2024, 2, 1),
        datetime(2024, 2, 2, 11, 0, 5),
    ]
    nothing = with_time(texts(spark, ["x", None]), "t", strict=False)
    assert first(nothing) == [None, None]
    assert first(with_time(texts(spark, [None, None]), "t")) == [None, None]


def test_unknown_layouts_are_not_silent(spark):
    with pytest.raises(UnknownTimes, match="all rows .2 texts"):
        with_time(texts(spark, ["Tuesday, late", "noon", None]), "t")
    rows = [("a", "2024-01-01 10.30", 1.0), ("b", "noon", 1.0), ("b", "night", 2.0)]
    df = spark.createDataFrame(rows, "`__run_key` string, Datetime string, Value double")
    with pytest.raises(UnknownTimes, match="b .2 texts"):
        fact_table(df)
    assert fact_table(df, strict=False).count() == 1


@pytest.mark.parametrize(
    "text, time",
    [
        ("2024/01/02 03:04:05.500", datetime(2024, 1, 2, 3, 4, 5, 500000)),
        ("13-01-2024 00:00", datetime(2024, 1, 13)),
        ("2024.01.02 03:04", datetime(2024, 1, 2, 3, 4)),
        ("02 Jan 2024 13:00", datetime(2024, 1, 2, 13)),
        ("2 January 2024", datetime(2024, 1, 2)),
        ("Jan 2, 2024 13:00", datetime(2024, 1, 2, 13)),
        ("02-Jan-2024 13:00", datetime(2024, 1, 2, 13)),
        ("2024-01-02 01:00 PM", datetime(2024, 1, 2, 13)),
        ("1/2/2024 12:30 AM", datetime(2024, 1, 2, 0, 30)),
        ("2024-01-02 03:04:05.123456", datetime(2024, 1, 2, 3, 4, 5, 123456)),
        ("2024-1-2 3:04", datetime(2024, 1, 2, 3, 4)),
    ],
)
def test_everyday_layouts(spark, text, time):
    assert first(with_time(texts(spark, [text]), "t")) == [time]


def test_runs_may_differ_in_layout(spark):
    rows = [("a", "2024-01-01 10.30"), ("b", "2024-01-01T11:30:00"), ("c", "31.12.2023")]
    rows += [("a", "2024-01-01T11:30:00")] + [("a", "2024-01-01 10.30")] * 4
    rows += [(None, "2024-02-01"), ("d", None), ("e", "x")]
    df = spark.createDataFrame([(*row, 1.0) for row in rows], "`__run_key` string, Datetime string, Value double")
    found = fact_table(df, strict=False).select("__run_key", "Datetime").distinct().collect()
    assert {tuple(row) for row in found} == {
        ("a", datetime(2024, 1, 1, 10, 30)),
        ("b", datetime(2024, 1, 1, 11, 30)),
        ("c", datetime(2023, 12, 31)),
        (None, datetime(2024, 2, 1)),
    }
    row = datetime_bounds(df, "Datetime").first()
    assert [str(row["min_date"]), str(row["max_date"])] == ["2023-12-31", "2024-02-01"]


def test_invalid_hours_become_null(spark):
    rows = texts(spark, ["2024-01-01T00:00:00", "2024-01-01T100:00:00", "2024-01-01T24:30:00"])
    assert first(with_time(rows, "t")) == [datetime(2024, 1, 1), None, None]


def test_numbers_are_no_times(spark):
    with pytest.raises(TypeError):
        with_time(spark.range(3), "id")


def test_bounds_are_those_of_the_times(spark):
    # As texts, 9.1.2024 is the largest and 10.12.2023 the smallest.
    rows = texts(spark, ["9.1.2024", "10.12.2023", "20.11.2023", None])
    row = datetime_bounds(rows, "t").first()
    assert [str(row["min_date"]), str(row["max_date"])] == ["2023-11-20", "2024-01-09"]
    row = datetime_bounds(rows, "absent").first()
    assert [row["min_date"], row["max_date"]] == [None, None]


def test_time_columns_need_more_than_ninety_percent(spark):
    nine = ["2024-01-01 10:00"] * 9 + ["x"]
    ten = ["2024-01-01 10:00"] * 10
    rows = [(1, a, b, "2030", None) for a, b in zip(nine, ten)]
    df = spark.createDataFrame(
        rows, "hour int, nine string, ten string, `__run_key` string, empty string"
    )
    assert detect_time_columns(df) == ["hour", "ten"]


def test_all_text_columns_and_rows_are_looked_at(spark):
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([["2024-01-01"] * 10], ", ".join(f"{n} string" for n in names))
    assert detect_time_columns(df) == names
    # The first thousands are times, but they are not more than 90 % of all.
    late = spark.range(20_000).coalesce(1)
    text = F.when(F.col("id") < 17_000, "2024-01-01").otherwise("x")
    assert detect_time_columns(late.select(text.alias("seen"))) == []


def test_fact_table_drops_bad_rows_only(spark):
    rows = [("2024-01-01 10.00", "1.5"), ("2024-01-01 11.00", "x"), ("bad", "2")]
    rows += [("2024-01-01 12.00", "nan")] * 2 + [("2024-01-01 13.00", " 7 ")] * 3
    facts = fact_table(spark.createDataFrame(rows, "Datetime string, Value string"))
    assert sorted(row["Value"] for row in facts.collect()) == [1.5, 7.0, 7.0, 7.0]
    numbers = [("2024-01-01 10.00", float("nan")), ("2024-01-01 10.00", None)]
    facts = fact_table(spark.createDataFrame(numbers, "Datetime string, Value double"))
    assert [row["Value"] for row in facts.collect()] == [None, None]
