import subprocess
import sys
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracemill.operators.clean import fact_table
from tracemill.plans.evaluate import evaluate
from tracemill.plans.traces import TraceSpec
from tracemill.sources import (
    discover_files,
    list_runs,
    load_files,
    load_runs,
    read_table,
    run_key,
    run_options,
    shared_folder,
    skipped_files,
)
from tracemill.sources.runs import as_list, data_folder, files_of_runs
from tracemill.sources.tables import available_columns, suffix_of


def write(path: Path, **columns) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix.lower() == ".csv":
        pd.DataFrame(columns).to_csv(path, index=False)
    else:
        pq.write_table(pa.table(columns), path)
    return path


@pytest.fixture
def root(tmp_path):
    """Runs with nested data, mixed types, odd names and suffixes."""
    base = tmp_path / "model runs"
    write(base / "AT 2030+a" / "out" / "deep" / "one.parquet", Value=[1.5], BZ=["AT"], WS=[4])
    write(base / "AT 2030+a" / "out" / "TWO.PARQUET", Value=[2], BZ=["AT"], WS=["4"])
    write(base / "AT 2030+a" / "elsewhere.parquet", Value=[99.0], BZ=["XX"])
    write(base / "DE" / "out" / "three.parquet", **{" Value ": [3.5], "BZ": ["DE"], "Sample": [1]})
    write(base / "DE" / "out" / "notes.txt", **{"Value": [0.0]})
    write(base / "FR" / "out" / "four.csv", BZ=["FR", "FR"], Value=[4.0, 5.0])
    write(base / "FR" / "out" / "FIVE.Csv", Value=[6], BZ=["FR"], Extra=["x"])
    write(base / ".hidden" / "out" / "six.parquet", Value=[7.0])
    (base / "empty").mkdir()
    (base / "file.parquet").write_text("no run")
    return str(base)


def values(df):
    return sorted((r["__run_key"], r["BZ"], float(r["Value"])) for r in df.collect())


ALL = [
    ("AT 2030+a", "AT", 1.5),
    ("AT 2030+a", "AT", 2.0),
    ("DE", "DE", 3.5),
    ("FR", "FR", 4.0),
    ("FR", "FR", 5.0),
    ("FR", "FR", 6.0),
]


def test_runs(spark, root):
    assert [r["run"] for r in list_runs(spark, root).collect()] == ["AT 2030+a", "DE", "FR", "empty"]
    assert list_runs(spark, root + "/nowhere").count() == 0
    options = run_options(spark.createDataFrame([(".",), ("DE",), ("DE",)], "run string"))
    assert {tuple(r) for r in options.collect()} == {(".", "(data root)"), ("DE", "DE")}


def test_new_runs_appear(spark, root, tmp_path):
    before = list_runs(spark, root).count()
    write(Path(root) / "new" / "out" / "x.parquet", Value=[8.0], BZ=["NN"])
    assert list_runs(spark, root).count() == before + 1
    assert ("new", "NN", 8.0) in values(load_runs(spark, root, data_path="out"))


def test_discovery(spark, root):
    files = discover_files(spark, root, data_path="out")
    found = sorted((r["run"], r["path"].rsplit("/", 1)[-1], r["suffix"]) for r in files.collect())
    assert found == [
        ("AT 2030+a", "TWO.PARQUET", ".parquet"),
        ("AT 2030+a", "one.parquet", ".parquet"),
        ("DE", "three.parquet", ".parquet"),
        ("FR", "FIVE.Csv", ".csv"),
        ("FR", "four.csv", ".csv"),
    ]
    assert files.where("length <= 0 or modified is null").count() == 0
    assert discover_files(spark, root, data_path=".").count() == 6
    assert discover_files(spark, root, runs="empty").count() == 0
    assert files_of_runs(files, ["DE", "FR"]).count() == 3
    assert files_of_runs(files, None).count() == 5


def test_load_unites_types_and_columns(spark, root):
    df = load_runs(spark, root, data_path="out")
    assert values(df) == ALL
    assert sorted(df.columns) == [
        "BZ", "Extra", "Sample", "Value", "WS", "__run_key", "__source_file"
    ]
    # Numbers in one file and texts in another become texts.
    assert dict(df.dtypes)["WS"] == "string"
    assert dict(df.dtypes)["Extra"] == "string"
    assert dict(df.dtypes)["Value"] == "double"
    names = {r[0].rsplit("/", 1)[-1] for r in df.select("__source_file").collect()}
    assert names == {"one.parquet", "TWO.PARQUET", "three.parquet", "four.csv", "FIVE.Csv"}


def test_load_some_runs_and_columns(spark, root):
    df = load_runs(spark, root, runs=["DE", "FR"], columns=["BZ", "Value", "nope"], data_path="out")
    assert sorted(df.columns) == ["BZ", "Value", "__run_key", "__source_file"]
    assert values(df) == [row for row in ALL if row[0] != "AT 2030+a"]
    with pytest.raises(ValueError):
        load_runs(spark, root, runs="empty")


def test_load_files(spark, root):
    paths = [r["path"] for r in discover_files(spark, root, ["DE", "AT 2030+a"], "out").collect()]
    assert values(load_files(spark, paths, root)) == ALL[:3]
    with pytest.raises(ValueError):
        load_files(spark, [], root)
    with pytest.raises(ValueError):
        load_files(spark, root + "/DE/out/notes.txt", root)


def test_one_layout_is_one_scan(spark, tmp_path):
    for i in range(6):
        write(tmp_path / f"r{i % 2}" / f"{i}.parquet", Value=[float(i)], BZ=["A"])
    df = load_runs(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert df.count() == 6


def test_many_files_of_mixed_layouts(spark, tmp_path):
    for i in range(1000):
        folder = tmp_path / f"r{i % 4}"
        columns = {"Value": [i if i % 3 else float(i)], "BZ": ["A"], f"C{i % 5}": ["x"]}
        write(folder / (f"{i}.csv" if i % 2 else f"{i}.parquet"), **columns)
    df = load_runs(spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString()
    assert plan.count(".parquet") + plan.count(".csv") < 700
    row = df.agg(F.count("Value"), F.sum("Value"), F.count("C3"), F.count("BZ")).first()
    assert tuple(row) == (1000, sum(range(1000)), 200, 1000)
    assert df.select("__source_file").distinct().count() == 1000


def test_csv_headers_may_differ_in_order(spark, tmp_path):
    write(tmp_path / "r" / "a.csv", Value=[1.5], BZ=["AT"], WS=[4])
    write(tmp_path / "r" / "b.csv", BZ=["DE"], Value=[2.5])
    write(tmp_path / "q" / "c+d e.csv", Extra=["x"], WS=[7], BZ=["FR"], Value=[3.5])
    df = load_runs(spark, str(tmp_path))
    found = sorted((r["__run_key"], r["BZ"], r["Value"], r["WS"], r["Extra"]) for r in df.collect())
    assert [row[:4] for row in found] == [
        ("q", "FR", "3.5", "7"), ("r", "AT", "1.5", "4"), ("r", "DE", "2.5", None)
    ]
    part = load_runs(spark, str(tmp_path), columns=["Value"]).select("Value")
    assert sorted(r["Value"] for r in part.collect()) == ["1.5", "2.5", "3.5"]


def test_hidden_names_are_told(spark, root):
    write(Path(root) / "DE" / "out" / "_tmp" / "x.parquet", Value=[1.0])
    write(Path(root) / "DE" / "out" / ".y.CSV", Value=[1.0])
    found = [r["path"] for r in skipped_files(spark, root, data_path="out").collect()]
    assert sorted(p.rsplit("/out/", 1)[1] for p in found) == [".y.CSV", "_tmp/x.parquet"]


def test_hidden_files_are_listed_and_loaded_when_asked_for(spark, root):
    base = Path(root) / "DE" / "out"
    write(base / "_tmp" / "x y.parquet", Value=[1], BZ=["_x"], WS=[7])
    write(base / ".y.CSV", Value=[2.5], BZ=["a\nb"], More=["m"])
    write(base / ".deep" / "plain" / "z.parquet", Value=["3"], BZ=["_z"])
    (base / "_tmp" / "_SUCCESS").write_text("")
    listed = discover_files(spark, root, data_path="out", hidden=True)
    assert listed.count() == 8 and listed.columns == discover_files(spark, root).columns
    plain = {tuple(r) for r in discover_files(spark, root, data_path="out").select("path", "run", "length").collect()}
    assert plain < {tuple(r) for r in listed.select("path", "run", "length").collect()}
    assert values(load_runs(spark, root, data_path="out")) == ALL
    df = load_runs(spark, root, data_path="out", hidden=True)
    more = [("DE", "_x", 1.0), ("DE", "a\nb", 2.5), ("DE", "_z", 3.0)]
    assert values(df) == sorted(ALL + more)
    assert {r["More"] for r in df.collect()} == {None, "m"}
    (Path(root) / "h").mkdir()
    write(Path(root) / "h" / "_only.parquet", Value=[9.0], BZ=["h"])
    assert values(load_runs(spark, root, "h", hidden=True)) == [("h", "h", 9.0)]
    write(Path(root) / "h" / "_nested.parquet", Value=[[9.0]])
    with pytest.raises(ValueError, match="nested"):
        load_runs(spark, root, "h", hidden=True)


def test_listing_takes_a_job_a_level(spark, tmp_path):
    from tracemill.sources.hidden import list_tree

    for i in range(40):
        write(tmp_path / "r" / f"d{i}" / "_h" / f"{i}.parquet", Value=[1.0])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    found = list_tree(spark, [str(tmp_path / "r")], str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("listing"))
    spark.sparkContext._jsc.clearJobGroup()
    assert found.where("hidden").count() == 40 and jobs < 20


def test_absolute_data_path(spark, root, tmp_path):
    shared = tmp_path / "shared"
    write(shared / "deep" / "a.parquet", Value=[1.0], BZ=["S"])
    df = load_runs(spark, root, data_path=str(shared))
    assert values(df) == [("AT 2030+a", "S", 1.0)]
    assert shared_folder(spark, root, "out") is None
    files = discover_files(spark, root, data_path=str(shared))
    assert [r["run"] for r in files.collect()] == ["AT 2030+a"]


def files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    metric = df._jdf.queryExecution().executedPlan()
    del plan
    leaves = metric.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        found = leaves.apply(i).metrics().get("numFiles")
        if found.isDefined():
            total += found.get().value()
    return total


def test_run_filter_prunes_files(spark, tmp_path):
    for i in range(4):
        write(tmp_path / f"run {i}" / "a.parquet", Value=[float(i)], BZ=["A"], WS=[1])
    df = load_runs(spark, str(tmp_path))
    assert files_read(df.select("Value")) == 4
    one = df.where(F.col("__run_key") == "run 2").select("Value")
    assert files_read(one) == 1
    assert [r["Value"] for r in one.collect()] == [2.0]


def test_names_are_no_patterns(spark, tmp_path):
    for i, run in enumerate(("run[1]", "run1", "a{b,c}", "x*y", "xzy")):
        write(tmp_path / run / f"{i}.parquet", Value=[float(i)], BZ=[run])
    assert discover_files(spark, str(tmp_path), "run[1]").count() == 1
    for run in ("run[1]", "a{b,c}", "x*y"):
        row = load_runs(spark, str(tmp_path), run).collect()
        assert [(r["__run_key"], r["BZ"]) for r in row] == [(run, run)]
    assert load_runs(spark, str(tmp_path)).count() == 5


def test_own_tag_columns(spark, tmp_path):
    write(tmp_path / "r" / "a.parquet", Value=[1.0], __source_file=["own"], __run_key=["mine"])
    row = load_runs(spark, str(tmp_path)).first()
    assert row["__run_key"] == "r" and row["__source_file"].endswith("a.parquet")
    row = load_runs(spark, str(tmp_path), columns=["Value", "__run_key"]).first()
    assert (row["__run_key"], row["__source_file"]) == ("mine", "own")


def test_read_table(spark, root):
    assert read_table(spark, root + "/DE/out/three.parquet").columns == ["Value", "BZ", "Sample"]
    assert read_table(spark, root + "/FR/out/FIVE.Csv").first()["Extra"] == "x"
    with pytest.raises(ValueError):
        read_table(spark, root + "/DE/out/notes.txt")


@pytest.mark.parametrize(
    "path, root, run",
    [
        ("file:///data/runs/AT/x/a.parquet", "file:/data/runs", "AT"),
        ("/data/runs/AT/a.parquet", "file:/data/runs", "AT"),
        ("file:/data/runs.old/AT/a.parquet", "file:/data/runs", "."),
        ("file:/data/runs/a.parquet", "file:/data/runs", "."),
        ("s3a://b/runs/AT/a.parquet", "s3a://b/runs", "AT"),
        ("s3a://b/runs/AT/a.parquet", "file:/runs", "."),
        ("hdfs://n:9000/runs/AT/a.parquet", "hdfs://n:9000/runs", "AT"),
        ("@/mnt/runs/AT/a.parquet", "file:/data/runs", "AT"),
        ("@/mnt/AT/a.parquet", "file:/data/runs", "."),
    ],
)
def test_run_key(spark, path, root, run):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(run_key(F.col("p"), root)).first()[0] == run


def test_small_helpers():
    assert as_list(None) == [] and as_list("a") == ["a"] and as_list(["a", "", "b"]) == ["a", "b"]
    assert suffix_of("/x/y.PARQUET") == ".parquet"
    assert available_columns(["a", "b"], ["b", "c", "b"]) == ["b"]
    assert data_folder("/r/", "AT", " ./ ") == "/r/AT"
    assert data_folder("/r", "AT", "x/y/") == "/r/AT/x/y"


def test_dispatch_fixture_end_to_end(spark, tmp_path):
    """Hourly generation of two runs, with ISO times in csv files."""
    for run, factor in (("low", 1), ("high", 10)):
        rows = [
            (f"2030-01-0{day}T{hour:02d}:00:00", "DE", 1982, "gen", tech, unit, factor * (hour + 1))
            for day in (1, 2)
            for hour in range(3)
            for tech, unit in (("Gas", "a"), ("Gas", "b"), ("PV", "c"))
        ]
        frame = pd.DataFrame(
            rows,
            columns=["Datetime", "BZ", "WS", "Property", "PEMMDB_TECHNOLOGY", "Unit Name", "Value"],
        )
        write(tmp_path / run / "dispatch.csv", **frame.to_dict("list"))
    facts = fact_table(load_runs(spark, str(tmp_path)))
    specs = [
        TraceSpec("low", 1982, "DE", "gen", "Gas", None, "mean", "day"),
        TraceSpec("high", "1982.0", "DE", "gen", "PV", None, "sum", "month"),
    ]
    found = evaluate(facts, specs).points.orderBy("trace_id", "time").collect()
    assert [(r["trace_id"], str(r["time"]), r["value"]) for r in found] == [
        (0, "2030-01-01 00:00:00", 4.0),
        (0, "2030-01-02 00:00:00", 4.0),
        (1, "2030-01-01 00:00:00", 120.0),
    ]


def test_workers_do_not_need_the_package(tmp_path):
    from pyspark import cloudpickle

    from tracemill.sources.tables import layout_reader

    path = write(tmp_path / "a.parquet", Value=[1.0])
    (tmp_path / "reader").write_bytes(cloudpickle.dumps(layout_reader()))
    code = (
        "import pandas, pathlib; from pyspark import cloudpickle;"
        "reader = cloudpickle.loads(pathlib.Path('reader').read_bytes());"
        f"files = pandas.DataFrame({{'path': ['{path}'], 'suffix': ['.parquet']}});"
        "print(next(reader([files]))['layout'][0])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "Value: double", done.stderr
