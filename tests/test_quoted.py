"""Csv records over line ends, in files that many tasks read, against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import joins
from tracemill.sources import load_runs
from tracemill.sources.quoted import csv_records, ends_inside, torn_files


def state(text, inside=False):
    """Whether a text ends inside quotes, character by character."""
    begins, i = not inside, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"':
            if text[i + 1 : i + 2] == '"':
                i += 1
            else:
                inside = False
        elif not inside and c == '"' and begins:
            inside = True
        begins = not inside and c == ","
        i += 1
    return inside


def test_lines_against_a_look_at_every_character():
    pick = random.Random(3)
    for _ in range(20_000):
        line = "".join(pick.choices(['"', ",", "a", '""', ' "', "b,"], [4, 3, 3, 1, 1, 1], k=pick.randint(0, 9)))
        for inside in (False, True):
            assert ends_inside(line, inside) == state(line, inside), (line, inside)
    assert not ends_inside('a,"b\\"', False) and not ends_inside('5" pipe,2', False)


def table(pick, rows):
    value = ["plain", "DE\nnorth", 'say "yes"', "a,b", "", "x\n\n\ny", "two\r\nlines", "ü\n語", '"\n"', "\n"]
    return [[str(i), pick.choice(value), pick.choice(value), f"{i}.5"] for i in range(rows)]


def put(path, rows, header=("id", "BZ", "note", "Value")):
    path.parent.mkdir(parents=True, exist_ok=True)
    made = io.StringIO()
    writer = csv.writer(made, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(made.getvalue().encode())


@pytest.mark.parametrize("share", ["64b", "1000b", "100m"])
def test_one_file_in_many_shares(spark, tmp_path, share):
    rows = table(random.Random(7), 400)
    rows[100][1] = "long\n" * 500  # a record over several shares
    put(tmp_path / "run a" / "x.csv", rows)
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", share)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = load_runs(spark, str(tmp_path))
        found = sorted([r["id"], r["BZ"], r["note"], r["Value"]] for r in df.collect())
        if share == "1000b":
            records = csv_records(spark, [str(tmp_path / "run a" / "x.csv")], {})
            assert records.count() == 400
            assert spark.read.text(str(tmp_path / "run a" / "x.csv")).rdd.getNumPartitions() > 5
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # Spark's reader takes an empty value as null.
    assert found == sorted([[v or None for v in row] for row in rows])
    assert df.select("__run_key").distinct().collect() == [("run a",)]
    assert df.first()["__source_file"].endswith("run a/x.csv")


def test_only_torn_files_are_read_that_way(spark, tmp_path):
    put(tmp_path / "r" / "plain.csv", [["1", "DE", "n", "1.5"]])
    put(tmp_path / "r" / "deep" / "quoted.csv", [["2", "D,E", 'a "b"', "2.5"]])
    put(tmp_path / "q" / "torn.csv", [["3.5", "DE\nnorth"]], ("Value", "BZ"))
    (tmp_path / "q" / "inch.csv").write_text('id,BZ,Value\n4,5" pipe,4.5\n5,"x\ny",5.5\n6,7" pipe,6.5\n')
    options = {"recursiveFileLookup": "true"}
    torn = torn_files(spark, [str(tmp_path)], options)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in torn.collect()) == ["inch.csv", "torn.csv"]
    df = load_runs(spark, str(tmp_path))
    rows = sorted((r["Value"], r["BZ"], r["id"], r["__run_key"]) for r in df.collect())
    assert rows == [
        ("1.5", "DE", "1", "r"), ("2.5", "D,E", "2", "r"), ("3.5", "DE\nnorth", None, "q"),
        ("4.5", '5" pipe', "4", "q"), ("5.5", "x\ny", "5", "q"), ("6.5", '7" pipe', "6", "q"),
    ]
    assert df.where(F.col("__run_key") == "r").count() == 2


def test_headers_with_breaks(spark, tmp_path):
    put(tmp_path / "r" / "x.csv", [["1", "2"]], ("Value", "name\nof area"))
    df = load_runs(spark, str(tmp_path))
    assert df.columns[:2] == ["Value", "name\nof area"] and [tuple(r)[:2] for r in df.collect()] == [("1", "2")]


@pytest.mark.parametrize("bound", [joins.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("torn", [False, True])
def test_rows_of_a_file_do_not_meet_in_one_task(spark, tmp_path, monkeypatch, torn, bound):
    rows = [[str(i), "DE\nnorth" if torn and i % 3 == 0 else "DE", "n", f"{i % 7}.5"] for i in range(2000)]
    put(tmp_path / "r" / "x.csv", rows)
    put(tmp_path / "q" / "y.csv", [row[::-1] for row in rows], ("Value", "note", "BZ", "id"))
    put(tmp_path / "q" / "z.csv", [["-1", "FR\nsouth" if torn else "FR"]], ("id", "BZ"))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    settings = {
        "spark.sql.files.maxPartitionBytes": "4k",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = load_runs(spark, str(tmp_path))
        found = sorted((r["__run_key"], r["id"], r["BZ"], r["note"], r["Value"]) for r in df.collect())
        tasks = df.groupBy("__source_file", F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    south = ("q", "-1", "FR\nsouth" if torn else "FR", None, None)
    assert found == sorted([(run, *row) for run in "qr" for row in rows] + [south], key=lambda row: row[:2])
    for name in ("x.csv", "y.csv"):
        shares = [row["count"] for row in tasks if row["__source_file"].endswith(name)]
        assert len(shares) > 3 and max(shares) < 1000, (name, shares)
