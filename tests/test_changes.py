"""A roll-up that follows its files: only parts of changed files are made anew."""

import os

import pytest
from pyspark.sql import functions as F
from test_sources import write

from tracemill.operators.rollup import rollup_technology
from tracemill.sources import load_runs
from tracemill.streaming import Changes, read_changed, refresh_changed


def put(path, low, high, **more):
    ids = range(low, high)
    columns = {
        "Datetime": [f"2024-01-0{1 + i % 5} 0{i % 3}.00" for i in ids],
        "BZ": ["DE" if i % 2 else "FR" for i in ids],
        "PEMMDB_TECHNOLOGY": [None if i % 7 == 0 else f"t{i % 3}" for i in ids],
        "Value": [float(i) for i in ids],
    }
    return write(path, **columns | more)


def rows(df):
    wanted = ("__run_key", "BZ", "PEMMDB_TECHNOLOGY", "WS", "Datetime", "Value")
    names = [name if name in df.columns else None for name in wanted]
    picked = df.select(*(F.col(n) if n else F.lit(None).alias(w) for n, w in zip(names, wanted)))
    return sorted(map(str, picked.collect()))


def expected(spark, root):
    from tracemill.operators.clean import fact_table

    facts = fact_table(load_runs(spark, root))
    if "WS" in facts.columns:
        facts = facts.withColumn("WS", F.col("WS").cast("double"))
    return rows(rollup_technology(facts, time_columns=["Datetime"]))


def test_roll_up_follows_added_rewritten_and_removed_files(spark, tmp_path):
    root, table = tmp_path / "runs [x]", str(tmp_path / "table")

    def refresh(**options):
        found = refresh_changed(spark, str(root), table, **options)
        assert rows(read_changed(spark, table)) == expected(spark, str(root))
        return found

    for i in range(6):
        put(root / f"r{i % 2}" / "a" / f"{i}.parquet", 10 * i, 10 * i + 10)
    put(root / "r0" / "lines.csv", 100, 120)
    assert refresh(part_bytes=4000) == Changes(7, 0, 0, 0)
    assert refresh() == Changes(0, 0, 0, 0)
    # Parts that no change touches keep their files.
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "parts").rglob("*.parquet")}
    put(root / "r2" / "late.parquet", 200, 230, WS=[4] * 30)
    assert refresh() == Changes(1, 0, 0, 0)
    put(root / "r0" / "a" / "0.parquet", 300, 305)  # rewritten
    (root / "r1" / "a" / "3.parquet").unlink()
    found = refresh(part_bytes=4000)
    assert (found.added, found.rewritten, found.removed) == (0, 1, 1) and found.reread < 7
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "parts").rglob("*.parquet")}
    assert before.items() <= after.items()
    # The same length and rows, but a later time: taken as rewritten.
    os.utime(root / "r2" / "late.parquet", (1, 1))
    assert refresh().rewritten == 1
    for file in root.rglob("*.csv"):
        file.unlink()
    assert refresh().removed == 1


def test_a_refresh_that_failed_changes_nothing(spark, tmp_path):
    root, table = tmp_path / "runs", tmp_path / "table"
    with pytest.raises(ValueError):
        read_changed(spark, str(table))
    put(root / "r" / "a.parquet", 0, 10)
    refresh_changed(spark, str(root), str(table))
    seen = rows(read_changed(spark, str(table)))
    # Parts without a manifest, and a manifest that was not written to its end.
    half = table / "manifest" / "version=2"
    half.mkdir()
    stray = spark.read.parquet(str(table / "parts")).drop("__part")
    stray.write.parquet(str(table / "parts" / "__part=stray-0"))
    assert rows(read_changed(spark, str(table))) == seen
    put(root / "r" / "b.parquet", 10, 20)
    assert refresh_changed(spark, str(root), str(table)).added == 1
    assert rows(read_changed(spark, str(table))) == expected(spark, str(root))


def test_all_files_may_go(spark, tmp_path):
    root, table = tmp_path / "runs", str(tmp_path / "table")
    put(root / "r" / "a.parquet", 0, 10)
    refresh_changed(spark, str(root), table)
    (root / "r" / "a.parquet").unlink()
    assert refresh_changed(spark, str(root), table) == Changes(0, 0, 1, 0)
    assert read_changed(spark, table).count() == 0
