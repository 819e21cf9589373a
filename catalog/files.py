"""Run folders, written from the events and read back through the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import EVENT_FACTS, event_facts, table
from tracemill.operators.clean import fact_table
from tracemill.plans.evaluate import evaluate, with_steps
from tracemill.plans.traces import TraceSpec
from tracemill.plans.visualize import load_facts, load_index, visualize
from tracemill.session import scratch_path
from tracemill.sources import (
    discover_files,
    list_runs,
    load_files,
    load_runs,
    read_table,
    run_key,
    run_options,
    time_bounds_of_runs,
)
from tracemill.sources.runs import files_of_runs
from tracemill.streaming import (
    new_files,
    read_changed,
    read_rollup,
    refresh_changed,
    refresh_rollup,
)

DATA_PATH = "results/hourly"
_written: dict[tuple[str, str], str] = {}


def run_root(spark: SparkSession, folder: str) -> str:
    """Events as three runs: two of parquet files with different columns and
    types, one of csv files. Written once for each session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _written:
        return _written[key]
    root = scratch_path(spark, "runs")
    events = table(spark, folder, "events")
    rows = events.select(
        F.date_format("ts", "yyyy-MM-dd HH.mm").alias("Datetime"),
        F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") * 100)).alias("Value"),
        (F.col("user_id") % 4).cast("int").alias("WS"),
        F.col("event_type").alias("BZ"),
        F.lit("level").alias("Property"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Unit Name"),
        (F.col("user_id") % 3).alias("part"),
    )

    def part(number: int) -> DataFrame:
        return rows.where(F.col("part") == number).drop("part")

    part(0).write.parquet(f"{root}/north/{DATA_PATH}/a")
    south = part(1).withColumn("Value", F.col("Value").cast("bigint")).drop("Unit Name")
    south.withColumnRenamed("Property", " Property ").write.parquet(f"{root}/south/{DATA_PATH}/b")
    part(2).write.option("header", "true").csv(f"{root}/west/{DATA_PATH}")
    _written[key] = root
    return root


FILE_FACTS = """file_facts as (
  select strftime(ts, '%Y-%m-%d %H.%M') as "Datetime", date_trunc('minute', ts) as t,
    case when event_id % 17 <> 0 then round(value * 100) end as "Value",
    (user_id % 4)::int as "WS", event_type as "BZ", 'level' as "Property",
    case when user_id % 3 <> 1 then 'u' || user_id end as "Unit Name",
    case user_id % 3 when 0 then 'north' when 1 then 'south' else 'west' end as "__run_key"
  from events)
"""
_ALL = '"Datetime", "Value", "WS", "BZ", "Property", "Unit Name", "__run_key"'


def whole(spark: SparkSession, folder: str) -> DataFrame:
    loaded = load_runs(spark, run_root(spark, folder), data_path=DATA_PATH)
    return loaded.drop("__source_file")


def projected(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["Value", "BZ", "Unit Name", "no_such_column"]
    loaded = load_runs(spark, run_root(spark, folder), columns=columns, data_path=DATA_PATH)
    return loaded.drop("__source_file")


def one_run(spark: SparkSession, folder: str) -> DataFrame:
    root = run_root(spark, folder)
    return load_runs(spark, root, runs="north", data_path=DATA_PATH).drop("__source_file")


def run_filter(spark: SparkSession, folder: str) -> DataFrame:
    return whole(spark, folder).where(F.col("__run_key") == "south")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The runs to choose from, with the rows that each holds."""
    runs = run_options(list_runs(spark, run_root(spark, folder)))
    rows = whole(spark, folder).groupBy(F.col("__run_key").alias("run"))
    return runs.join(rows.agg(F.count(F.lit(1)).alias("rows")), "run", "left")


def one_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every parquet file of a run, read on its own."""
    root = run_root(spark, folder)
    files = discover_files(spark, root, "north", DATA_PATH).orderBy("path").collect()
    frames = [read_table(spark, row["path"]) for row in files]
    return reduce(DataFrame.unionByName, frames)


def tagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each file by its tag: what is before the file's own name, and its suffix."""
    loaded = load_runs(spark, run_root(spark, folder), data_path=DATA_PATH)
    path = F.col("__source_file")
    return loaded.groupBy(
        F.regexp_extract(path, r"/([^/]+)/results/hourly", 1).alias("run"),
        F.regexp_extract(path, r"/results/hourly/(?:([^/]+)/)?[^/]+$", 1).alias("inner"),
        F.regexp_extract(path, r"(\.[^./]+)$", 1).alias("suffix"),
        (F.col("__run_key") == F.regexp_extract(path, r"/([^/]+)/results/hourly", 1)).alias("agrees"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def absolute_path(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs that share one data folder elsewhere: its files are of the first."""
    root, shared = scratch_path(spark, "runs"), scratch_path(spark, "shared")
    events = table(spark, folder, "events")
    for run in ("beta", "alpha"):
        events.limit(1).write.parquet(f"{root}/{run}/own")
    events.select("event_id", "event_type").write.parquet(f"{shared}/deep")
    loaded = load_runs(spark, root, data_path=shared)
    return loaded.groupBy("__run_key", "event_type").agg(F.count(F.lit(1)).alias("rows"))


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    files = discover_files(spark, run_root(spark, folder), data_path=DATA_PATH)
    return files.groupBy("run", "suffix").agg((F.sum("length") > 0).alias("filled"))


def chosen_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of two runs, loaded by their paths."""
    root = run_root(spark, folder)
    files = files_of_runs(discover_files(spark, root, data_path=DATA_PATH), ["north", "west"])
    paths = [row["path"] for row in files.select("path").orderBy("path").toLocalIterator()]
    return load_files(spark, paths, root).drop("__source_file")


def keys_of_paths(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("file:/data/runs/a b/x/"), key))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("s3a://store/data/runs/"), "event_type", F.lit("/y"), key))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("/elsewhere/runs/"), key))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("@/mnt/runs/"), "event_type", F.lit("/"), key))
        .otherwise(F.concat(F.lit("@/mnt/"), key))
    )
    paths = table(spark, folder, "events").select(path.alias("path"))
    return paths.groupBy(run_key(F.col("path"), "file:/data/runs").alias("run")).agg(
        F.count(F.lit(1)).alias("files")
    )


SPECS = [
    TraceSpec("north", 0, "click", "level", None, None, "sum", "week"),
    TraceSpec("south", 1, "view", "level", None, None, "mean", "day"),
    TraceSpec("west", "2", "error", "level", None, None, "max", "month"),
]


def file_traces(spark: SparkSession, folder: str) -> DataFrame:
    """From folders to points: load, parse, match, aggregate, expand."""
    loaded = load_runs(spark, run_root(spark, folder), data_path=DATA_PATH)
    result = evaluate(fact_table(loaded), SPECS)
    return with_steps(result.points).select("trace_id", "time", "value")


QUERIES = {
    "multi_file_union": whole,
    "projected_load": projected,
    "run_pruned_load": one_run,
    "run_filtered_load": run_filter,
    "run_listing": listed,
    "single_file_load": one_file,
    "source_tag": tagged_rows,
    "run_key_absolute_data_path": absolute_path,
    "discover_files": discovered,
    "chosen_file_load": chosen_files,
    "run_key_from_path": keys_of_paths,
    "file_traces": file_traces,
}
ORACLES = {
    "multi_file_union": f"with {FILE_FACTS} select {_ALL} from file_facts",
    "projected_load": f'with {FILE_FACTS} select "Value", "BZ", "Unit Name", "__run_key" from file_facts',
    "run_pruned_load": f"with {FILE_FACTS} select {_ALL} from file_facts where \"__run_key\" = 'north'",
    "run_filtered_load": f"with {FILE_FACTS} select {_ALL} from file_facts where \"__run_key\" = 'south'",
    "run_listing": f"""with {FILE_FACTS} select "__run_key" as run, "__run_key" as label,
  count(*) as rows from file_facts group by 1""",
    "single_file_load": f"""with {FILE_FACTS} select "Datetime", "Value", "WS", "BZ", "Property",
  "Unit Name" from file_facts where "__run_key" = 'north'""",
    "source_tag": f"""with {FILE_FACTS} select "__run_key" as run,
  case "__run_key" when 'north' then 'a' when 'south' then 'b' else '' end as "inner",
  case when "__run_key" = 'west' then '.csv' else '.parquet' end as suffix, true as agrees,
  count(*) as rows from file_facts group by 1""",
    "run_key_absolute_data_path": """select 'alpha' as "__run_key", event_type, count(*) as rows
from events group by all""",
    "discover_files": f"""with {FILE_FACTS} select "__run_key" as run,
  case when "__run_key" = 'west' then '.csv' else '.parquet' end as suffix, true as filled
from file_facts group by 1""",
    "chosen_file_load": f"with {FILE_FACTS} select {_ALL} from file_facts where \"__run_key\" <> 'south'",
    "run_key_from_path": """select case event_id % 5 when 0 then 'a b' when 3 then event_type
  else '.' end as run, count(*) as files from events group by 1""",
    "file_traces": f"""with {FILE_FACTS},
points as (
  select 0 as trace_id, date_trunc('week', t - interval 1 day) + interval 1 day as time,
    coalesce(sum("Value"), 0) as value, interval 7 day as length from file_facts
  where "__run_key" = 'north' and "WS" = 0 and "BZ" = 'click' group by 1, 2
  union all select 1, date_trunc('day', t), avg("Value"), interval 1 day from file_facts
  where "__run_key" = 'south' and "WS" = 1 and "BZ" = 'view' group by 1, 2
  union all select 2, date_trunc('month', t), max("Value"), interval 1 month from file_facts
  where "__run_key" = 'west' and "WS" = 2 and "BZ" = 'error' group by 1, 2)
select trace_id, unnest([time, time + length - interval 1 microsecond]) as time, value from points""",
}


def refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """A roll-up that is refreshed after one run, and again after another: the second
    writes csv files, and both have files beside the data path."""
    root, kept, progress = (scratch_path(spark, name) for name in ("new", "rollup", "progress"))
    events = event_facts(spark, folder)
    schema = events.drop("__run_key").schema
    layout = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    for run in ("run_0", "run_1"):
        part = events.where(F.col("__run_key") == run).drop("__run_key")
        part.limit(3).write.parquet(f"{root}/{run}/elsewhere")
        if run == "run_0":
            part.write.parquet(f"{root}/{run}/{DATA_PATH}")
        else:
            part.write.options(header="true", **layout).csv(f"{root}/{run}/{DATA_PATH}")
        found = new_files(spark, root, schema, data_path=DATA_PATH, csv_options=layout)
        refresh_rollup(found, kept, progress, ["Datetime"])
    return read_rollup(spark, kept, ["Datetime"])


def plotted(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        facts = load_facts(spark, run_root(spark, folder), SPECS, DATA_PATH)
        return visualize(facts, SPECS, mode).data

    return query


def plot_report(spark: SparkSession, folder: str) -> DataFrame:
    specs = [*SPECS, TraceSpec("north", 9, "click", "level")]
    facts = load_facts(spark, run_root(spark, folder), specs, DATA_PATH)
    return visualize(facts, specs, "density").report


def file_index(spark: SparkSession, folder: str) -> DataFrame:
    index = load_index(spark, run_root(spark, folder), data_path=DATA_PATH)
    return index.drop("__source_file").distinct()


QUERIES |= {
    "file_selector_index": file_index,
    "refresh_rollup": refreshed,
    "plot_duration_curve": plotted("duration_curve"),
    "plot_stacked_area": plotted("stacked_area"),
    "plot_report": plot_report,
}
_POINTS = ORACLES["file_traces"].rsplit("\n", 1)[0] + """,
steps as (select trace_id, unnest([time, time + length - interval 1 microsecond]) as time, value
  from points)"""
ORACLES |= {
    "file_selector_index": f"""with {FILE_FACTS} select distinct "__run_key", "BZ", "WS",
  "Property", "Unit Name" from file_facts""",
    "refresh_rollup": f"""with {EVENT_FACTS}
select "__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "WS", "Datetime",
  coalesce(sum("Value"), 0) as "Value" from event_facts group by all""",
    "plot_duration_curve": _POINTS
    + """
select trace_id, row_number() over series as rank,
  row_number() over series / count(*) over (partition by trace_id) * 100.0 as x, value from steps
window series as (partition by trace_id order by value desc nulls last)""",
    "plot_stacked_area": _POINTS
    + """,
cells as (select trace_id, time, coalesce(value, 0) as value from steps),
grid as (select trace_id, time from (select distinct trace_id from cells) a,
  (select distinct time from cells) b),
filled as (select trace_id, time, coalesce(value, 0) as value from grid
  left join cells using (trace_id, time))
select trace_id, time, value, coalesce(sum(value) over (partition by time order by trace_id
    rows between unbounded preceding and 1 preceding), 0) as y0,
  sum(value) over (partition by time order by trace_id) as y1 from filled""",
    "plot_report": _POINTS
    + """,
asked as (select * from (values
  (0, 'north | WS 0 | click | level [sum/week]'), (1, 'south | WS 1 | view | level [mean/day]'),
  (2, 'west | WS 2 | error | level [max/month]'), (3, 'north | WS 9 | click | level'))
  t(trace_id, label))
select trace_id, label, count(time) as points,
  case when count(value) > 0 then 'ok' else 'missing' end as status
from asked left join steps using (trace_id) group by all""",
}


def every_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every parquet file of all runs, read on its own."""
    files = discover_files(spark, run_root(spark, folder), data_path=DATA_PATH)
    paths = files.where("suffix = '.parquet'").orderBy("path").select("path").toLocalIterator()
    frames = [read_table(spark, row["path"]) for row in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def timed_runs(spark: SparkSession, folder: str) -> str:
    """Events as runs whose files tell their times by statistics, or hold them as texts."""
    key = (spark.sparkContext.applicationId, f"{folder} by time")
    if key in _written:
        return _written[key]
    root = scratch_path(spark, "timed")
    events = table(spark, folder, "events").withColumn("day", F.col("ts").cast("date"))
    forms = {
        "naive": F.col("ts").cast("timestamp_ntz"),
        "days": F.col("day"),
        "old": F.col("ts").cast("timestamp"),
        "texts": F.date_format("ts", "yyyy-MM-dd HH.mm"),
        "lines": F.date_format("ts", "d/M/yyyy H:mm"),
    }
    for number, (run, time) in enumerate(forms.items()):
        rows = events.where(F.col("user_id") % 5 == number)
        rows = rows.select(time.alias("Datetime"), "value", F.lit(number).alias(f"Extra {run}"))
        if run == "lines":
            rows.write.option("header", "true").csv(f"{root}/{run}/{DATA_PATH}")
        else:
            rows.repartition(3).write.parquet(f"{root}/{run}/{DATA_PATH}")
    _written[key] = root
    return root


def bounds_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Date bounds of each run, and of all."""
    root = timed_runs(spark, folder)
    found = []
    for run in (*(row["run"] for row in list_runs(spark, root).collect()), None):
        days = time_bounds_of_runs(spark, root, "Datetime", run, DATA_PATH)
        texts = (F.col(c).cast("string").alias(c) for c in days.columns)
        found.append(days.select(F.lit(run or "all").alias("run"), *texts))
    return reduce(DataFrame.unionByName, found)


QUERIES |= {"every_file_load": every_file, "datetime_bounds_from_footers": bounds_of_runs}
ORACLES |= {
    "every_file_load": f"""with {FILE_FACTS} select "Datetime", "Value", "WS", "BZ", "Property",
  "Unit Name" from file_facts where "__run_key" in ('north', 'south')""",
    "datetime_bounds_from_footers": """with d as (select ts::date as day,
    case user_id % 5 when 0 then 'naive' when 1 then 'days' when 2 then 'old' when 3 then 'texts'
      else 'lines' end as run from events)
select run, min(day)::varchar as min_date, max(day)::varchar as max_date from d group by run
union all select 'all', min(day)::varchar, max(day)::varchar from d""",
}


def refreshed_after_change(spark: SparkSession, folder: str) -> DataFrame:
    """A roll-up that follows its files: some are added, some written anew, some go.

    Events are dealt to eight folders. At first there are the folders 0 to 4, 4 as csv.
    Then 5 and 6 appear, the files of 1 hold three times their values, and those of 2 and
    4 only one kind of event: writing a folder anew removes its old files.
    """
    root, kept = scratch_path(spark, "changing"), scratch_path(spark, "rollup")
    often = F.col("BZ").isin("click", "view", "error").cast("int")
    events = event_facts(spark, folder).withColumn("part", F.col("WS").cast("int") * 2 + often)
    layout = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

    def write(part: int, rows: DataFrame) -> None:
        path = f"{root}/run_{part // 2 % 2}/{DATA_PATH}/k{part}"
        rows = rows.where(F.col("part") == part).drop("part", "__run_key")
        if part == 4:
            rows.write.mode("overwrite").options(header="true", **layout).csv(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    for part in range(5):
        write(part, events)
    refresh_changed(spark, root, kept, data_path=DATA_PATH)
    write(5, events)
    write(6, events)
    write(1, events.withColumn("Value", F.col("Value") * 3))
    for part in (2, 4):
        write(part, events.where("BZ = 'signup'"))
    refresh_changed(spark, root, kept, data_path=DATA_PATH, part_bytes=100_000)
    return read_changed(spark, kept)


QUERIES |= {"refresh_after_change": refreshed_after_change}
ORACLES |= {
    "refresh_after_change": f"""with {EVENT_FACTS},
dealt as (select *, "WS"::int * 2 + ("BZ" in ('click', 'view', 'error'))::int as part from event_facts)
select "__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "WS", "Datetime",
  coalesce(sum("Value" * case when part = 1 then 3 else 1 end), 0) as "Value"
from dealt where part < 7 and ("BZ" = 'signup' or part not in (2, 4)) group by all""",
}


def quoted_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Csv files in which areas hold line ends, quotes and commas, beside plain ones."""
    root = scratch_path(spark, "quoted")
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    area = (
        F.when(F.col("user_id") % 4 == 0, F.concat(kind, F.lit("\nnorth")))
        .when(F.col("user_id") % 4 == 1, F.concat(F.lit('the "'), kind, F.lit('", or\n\nnot')))
        .when(F.col("user_id") % 4 == 2, F.concat(F.lit('5" of '), kind))
        .otherwise(kind)
    )
    rows = events.select("event_id", area.alias("BZ"), (F.col("user_id") % 3).alias("WS"), (F.col("user_id") % 2).alias("run"))
    for run in (0, 1):
        own = rows.where(F.col("run") == run).drop("run").repartition(2)
        layout = {"header": "true", "escape": '"', "quoteAll": "true" if run else "false"}
        own.write.options(**layout).csv(f"{root}/run_{run}/{DATA_PATH}")
    return load_runs(spark, root, data_path=DATA_PATH).drop("__source_file")


QUERIES |= {"csv_quoted_breaks": quoted_breaks}
ORACLES |= {
    "csv_quoted_breaks": """select event_id::varchar as event_id, (user_id % 3)::varchar as "WS",
  'run_' || (user_id % 2) as "__run_key",
  case user_id % 4 when 0 then event_type || chr(10) || 'north'
    when 1 then 'the "' || event_type || '", or' || chr(10) || chr(10) || 'not'
    when 2 then '5" of ' || event_type else event_type end as "BZ" from events""",
}


def hidden_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all files by the folder they are in, those that Spark hides included."""
    root = scratch_path(spark, "hidden")
    events = table(spark, folder, "events")
    rows = events.select("event_id", F.round(F.col("value") * 100).alias("Value"), F.col("ts").cast("timestamp_ntz").alias("Datetime"))
    places = ("plain", "_staged", "deep/.late", "_lines")
    for number, place in enumerate(places):
        own = rows.where(F.col("event_id") % len(places) == number)
        path = f"{root}/run_{number % 2}/{DATA_PATH}/{place}"
        if place == "_lines":
            own.write.options(header="true", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
        elif place == "_staged":
            own.withColumn("Value", F.col("Value").cast("bigint")).write.parquet(path)
        else:
            own.write.parquet(path)
    listed = discover_files(spark, root, data_path=DATA_PATH, hidden=True)
    known = listed.groupBy("run", F.regexp_extract("path", rf"/{DATA_PATH}/(.+)/[^/]+$", 1).alias("place"))
    known = known.agg((F.min("length") > 0).alias("filled"))
    loaded = load_runs(spark, root, data_path=DATA_PATH, hidden=True)
    place = F.regexp_extract("__source_file", rf"/{DATA_PATH}/(.+)/[^/]+$", 1).alias("place")
    sums = loaded.groupBy(F.col("__run_key").alias("run"), place).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("Value").alias("total"),
        F.max("Datetime").cast("string").alias("last"),
    )
    return known.join(sums, ["run", "place"], "full")


QUERIES |= {"discover_hidden_files": hidden_files}
ORACLES |= {
    "discover_hidden_files": """select 'run_' || (event_id % 2) as run,
  case event_id % 4 when 0 then 'plain' when 1 then '_staged' when 2 then 'deep/.late' else '_lines' end
    as place, true as filled, count(*) as rows, sum(round(value * 100)) as total,
  regexp_replace(max(ts)::varchar, '\\.?0+$', '') as last from events group by all""",
}


def remembered_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Traces over files whose layouts an earlier load has found."""
    root, memory = run_root(spark, folder), scratch_path(spark, "memory")
    load_facts(spark, root, SPECS[:1], DATA_PATH, memory=memory)
    load_facts(spark, root, SPECS, DATA_PATH, memory=memory)
    facts = load_facts(spark, root, SPECS, DATA_PATH, memory=memory)
    return with_steps(evaluate(facts, SPECS).points).select("trace_id", "time", "value")


QUERIES |= {"file_traces_remembered": remembered_traces}
ORACLES |= {"file_traces_remembered": ORACLES["file_traces"]}
