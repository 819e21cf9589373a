"""Layouts that an earlier load has found: no file is looked at twice."""

import os

import pytest
from test_sources import write

from tracemill.operators.clean import UnknownTimes, time_readings
from tracemill.plans.traces import TraceSpec
from tracemill.plans.visualize import load_facts
from tracemill.sources import load_runs
from tracemill.sources import memory as remembering
from tracemill.sources.memory import remembered_readings

HINT = ["2024-01-0%d 10.30" % d for d in range(1, 9)]
SLASHED = ["%d/2/2024" % d for d in range(10, 18)]


def put(path, times, **more):
    return write(path, Datetime=times, Value=[1.0] * len(times), BZ=["A"] * len(times), WS=[1] * len(times), **more)


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "runs"
    put(base / "a" / "1.parquet", HINT)
    put(base / "a" / "2.parquet", HINT[:4])
    put(base / "b" / "1.csv", SLASHED)
    write(base / "b" / "none.parquet", BZ=["A"])
    return base


def readings(spark, root, memory, runs=None):
    loaded = load_runs(spark, str(root), runs)
    found = remembered_readings(spark, str(root), loaded, "Datetime", str(memory), runs)
    assert found == time_readings(loaded, "Datetime", "__run_key")
    return {run: reading.layout for run, reading in found.items()}


def test_only_new_and_changed_files_are_looked_at(spark, root, tmp_path, monkeypatch):
    memory, seen = tmp_path / "memory", []
    look = remembering.load_chosen

    def counted(spark, root, files, chosen, *rest):
        seen.append(sorted("/".join(r["path"].rsplit("/", 2)[1:]) for r in chosen.collect()))
        return look(spark, root, files, chosen, *rest)

    monkeypatch.setattr(remembering, "load_chosen", counted)
    assert readings(spark, root, memory, ["a"]) == {"a": "hint"}
    assert readings(spark, root, memory) == {"a": "hint", "b": "slash_day_first"}
    assert readings(spark, root, memory) == {"a": "hint", "b": "slash_day_first"}
    assert seen == [["a/1.parquet", "a/2.parquet"], ["b/1.csv", "b/none.parquet"]]
    # The larger file of the run gets another layout; what was remembered of it is stale.
    put(root / "a" / "1.parquet", SLASHED * 3)
    assert readings(spark, root, memory)["a"] == "slash_day_first"
    os.utime(root / "b" / "1.csv", (1, 1))
    (root / "a" / "2.parquet").unlink()
    put(root / "c" / "late.parquet", HINT)
    assert readings(spark, root, memory) == {"a": "slash_day_first", "b": "slash_day_first", "c": "hint"}
    assert seen[2:] == [["a/1.parquet"], ["b/1.csv", "c/late.parquet"]]


def test_later_loads_have_no_job_over_the_texts(spark, root, tmp_path, monkeypatch):
    from tracemill.operators import shapes

    specs = [TraceSpec(run, 1, "A", "p") for run in "ab"]
    wanted = sorted(map(str, load_facts(spark, str(root), specs).collect()))
    memory, looks, look = str(tmp_path / "memory"), [], shapes._raw_counts
    monkeypatch.setattr(shapes, "_raw_counts", lambda texts: looks.append(1) or look(texts))
    for expected in (1, 1, 1):  # the first load looks, the later ones do not
        facts = load_facts(spark, str(root), specs, memory=memory)
        assert sorted(map(str, facts.collect())) == wanted and len(looks) == expected


def test_unknown_times_stay_unknown(spark, root, tmp_path):
    put(root / "d" / "1.parquet", ["noon", "night"])
    specs = [TraceSpec("d", 1, "A", "p")]
    for _ in range(2):
        with pytest.raises(UnknownTimes, match="d .2 texts"):
            load_facts(spark, str(root), specs, memory=str(tmp_path / "memory"))


def test_times_that_are_no_texts_need_no_memory(spark, tmp_path):
    import datetime as dt

    put(tmp_path / "runs" / "a" / "1.parquet", [dt.datetime(2024, 1, 1)])
    loaded = load_runs(spark, str(tmp_path / "runs"))
    args = (spark, str(tmp_path / "runs"), loaded)
    assert remembered_readings(*args, "Datetime", str(tmp_path / "memory")) is None
    assert remembered_readings(*args, "absent", str(tmp_path / "memory")) is None
    assert not (tmp_path / "memory").exists()
