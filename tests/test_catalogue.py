"""Reads and bounds planned from footers: few scans, no column read without need."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sources import write

from tracemill.sources import load_runs, time_bounds_of_runs
from tracemill.sources.catalogue import file_catalogue, group_schema, layout_groups
from tracemill.sources.runs import files_in


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def jobs(spark, work):
    """The result of ``work`` and how many jobs it started."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        found = work()
        return found, len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context._jsc.clearJobGroup()


def test_runs_of_two_layouts_are_two_scans(spark, tmp_path):
    for i in range(300):
        value = [float(i)] if i % 2 else [f"{i}"]
        write(tmp_path / f"run{i:03d}" / "out" / "a.parquet", Value=value, BZ=["A"], **{f"C{i % 3}": [i]})
    few, many = str(tmp_path / "few"), str(tmp_path)
    for i in range(2):
        write(tmp_path / "few" / f"r{i}" / "out" / "a.parquet", Value=[1.0] if i else ["1"])
    df, started = jobs(spark, lambda: load_runs(spark, many, [f"run{i:03d}" for i in range(300)], data_path="out"))
    assert scans(df) == 2
    assert df.count() == 300 and df.agg(F.sum(F.col("Value").cast("double"))).first()[0] == sum(range(300))
    assert df.select("__run_key").distinct().count() == 300 and df.where("C1 is null").count() == 200
    # No more jobs than for two runs: footers are read in one, the rest works on what it found.
    assert started <= jobs(spark, lambda: load_runs(spark, few, data_path="out"))[1]


def test_mixed_folders_name_files_and_others_are_read_whole(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / "r" / ("mixed" if i % 2 else "pure/deep" if i % 4 else "pure")
        write(folder / f"{i}.parquet", Value=[i] if i % 4 != 1 else [str(i)])
    df = load_runs(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().analyzed().toString()
    assert df.count() == 60 and scans(df) == 2 and plan.count("pure/") == 0
    assert sorted(int(r["Value"]) for r in df.collect()) == list(range(60))


def test_layouts_that_exclude_one_another():
    a, b = (("t", "int"), ("x", "int")), (("t", "string"),)
    c, d = (("x", "int"), ("y", "int")), (("T", "int"),)
    groups = layout_groups([a, b, c, d])
    assert sorted(map(len, groups)) == [1, 1, 2]
    assert all(len({a, b, d} & set(members)) == 1 for members in groups)
    assert group_schema([a, c]).names == ["t", "x", "y"]
    assert group_schema([(("t", "?"),)]) is None
    assert layout_groups([]) == []


def test_types_are_those_of_the_reader(spark, tmp_path):
    rows = spark.sql(
        "select cast(1 as tinyint) a, cast(1 as smallint) b, 1 c, 1L d, cast(1 as float) e, 1d f, true g,"
        " 'x' h, binary('x') i, cast(1.5 as decimal(9,2)) j, cast(1.5 as decimal(30,2)) k,"
        " date'2024-01-02' l, timestamp'2024-01-02 03:04:05' m, timestamp_ntz'2024-01-02 03:04:05' n"
    )
    rows.write.parquet(f"{tmp_path}/r/out")
    nested = rows.select("a", F.array("c").alias("list"), F.struct("c", "d").alias("both"))
    nested.write.parquet(f"{tmp_path}/s/out")
    known = file_catalogue(files_in(spark, [f"{tmp_path}/r/out"], str(tmp_path)))
    types = tuple(map(tuple, json.loads(known.first()["types"])))
    assert group_schema([types]) == spark.read.parquet(f"{tmp_path}/r/out").schema
    df = load_runs(spark, str(tmp_path), data_path="out")
    assert df.count() == 2 and dict(df.dtypes)["both"] == "struct<c:int,d:bigint>"


def bounds(spark, root, *args, **options):
    df = time_bounds_of_runs(spark, str(root), "Datetime", *args, **options)
    return tuple(df.first()), df


DAYS = [dt.datetime(2024, 3, d, 5, 6) for d in (9, 2, 30, 17)]


def test_statistics_answer_without_a_look_at_the_column(spark, tmp_path):
    for run, kind in (("a", pa.timestamp("ms")), ("b", pa.timestamp("us", "UTC")), ("c", pa.date32())):
        column = pa.array(DAYS).cast(pa.timestamp("us")).cast(kind)
        path = tmp_path / run / "x.parquet"
        path.parent.mkdir()
        pq.write_table(pa.table({" Datetime ": column, "Value": [1.0] * 4}), path, row_group_size=2)
    none = pa.table({" Datetime ": pa.array([None, None], pa.timestamp("us"))})
    pq.write_table(none, tmp_path / "a" / "none.parquet")
    write(tmp_path / "a" / "other.parquet", Value=[1.0])
    for runs in (None, "a", "b", "c"):
        found, df = bounds(spark, tmp_path, runs)
        assert found == (dt.date(2024, 3, 2), dt.date(2024, 3, 30))
        assert df.inputFiles() == [] and scans(df) == 0


def test_files_without_statistics_are_read_and_no_others(spark, tmp_path):
    write(tmp_path / "a" / "x.parquet", Datetime=pa.array(DAYS, pa.timestamp("us")))
    late = pa.table({"Datetime": pa.array([dt.datetime(2024, 5, 1)], pa.timestamp("us"))})
    pq.write_table(late, tmp_path / "a" / "plain.parquet", write_statistics=False)
    write(tmp_path / "a" / "y.parquet", Datetime=["2024-06-01 10.30"] * 4 + ["2024-02-01 00.00", "soon"])
    found, df = bounds(spark, tmp_path)
    assert found == (dt.date(2024, 2, 1), dt.date(2024, 6, 1))
    assert sorted(path[-7:] for path in df.inputFiles()) == ["parquet"] * 2 and scans(df) == 2
    write(tmp_path / "b" / "z.csv", Value=[1], Datetime=["2024-07-01 10.30"])
    assert bounds(spark, tmp_path)[0] == (dt.date(2024, 2, 1), dt.date(2024, 7, 1))
    assert bounds(spark, tmp_path, "b")[0] == (dt.date(2024, 7, 1),) * 2
    spark.sql("select timestamp'2025-01-02 00:00:00' as Datetime").write.parquet(f"{tmp_path}/c")
    assert bounds(spark, tmp_path, "c")[0] == (dt.date(2025, 1, 2),) * 2


@pytest.mark.parametrize("runs", [None, "a"])
def test_no_such_column(spark, tmp_path, runs):
    write(tmp_path / "a" / "x.parquet", Value=[1.0])
    write(tmp_path / "a" / "y.csv", Value=[1.0])
    (tmp_path / "b").mkdir()
    assert bounds(spark, tmp_path, runs)[0] == (None, None)
    assert bounds(spark, tmp_path, "b")[0] == (None, None)
