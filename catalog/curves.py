"""Duration curves, densities and stacked areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import event_facts, item_facts
from catalog.traces import MIXED, facts_of, item_specs, event_specs, points_sql, with_facts
from tracemill.functions.labels import series_label
from tracemill.operators.curves import (
    density,
    duration_curve,
    duration_curve_frame,
    first_technology,
    stacked_area,
)
from tracemill.operators.selector import series_order
from tracemill.plans.evaluate import evaluate, with_steps
from tracemill.plans.traces import TraceSpec

STACK = [
    *event_specs("sum", "day"),
    TraceSpec("run_1", 0, "error", "load", None, None, "sum", "day"),
    TraceSpec("run_0", 0, "purchase", "load", None, None, "mean", "week"),
]


def trace_points(spark, folder, specs, facts, steps=True, **options) -> DataFrame:
    points = evaluate(facts_of(spark, folder, facts), specs, **options).points
    return with_steps(points) if steps else points


def duration(spark: SparkSession, folder: str) -> DataFrame:
    return duration_curve(trace_points(spark, folder, MIXED, "event_facts"))


def duration_units(spark: SparkSession, folder: str) -> DataFrame:
    """Raw unit values, with nulls."""
    specs = [TraceSpec(None, ws, "view", None, None, None, "none") for ws in (0, 1, 2)]
    return duration_curve(
        trace_points(spark, folder, specs, "event_facts", False, unit_detail=True)
    )


def duration_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All values of all runs, as one raw trace per area."""
    specs = [
        TraceSpec(None, ws, area, None, None, None, "none")
        for ws in range(4)
        for area in ("click", "view", "purchase", "error")
    ]
    return duration_curve(trace_points(spark, folder, specs, "event_facts", False, unit_detail=True))


def duration_series(spark: SparkSession, folder: str) -> DataFrame:
    facts = event_facts(spark, folder)
    named = facts.withColumn("series", series_label(["BZ", "PEMMDB_TECHNOLOGY"]))
    return duration_curve_frame(named, "series", "Value")


def duration_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """All line items in three series."""
    return duration_curve_frame(item_facts(spark, folder), "BZ", "Value")


def duration_tied(spark: SparkSession, folder: str) -> DataFrame:
    """Series of few distinct values: each value has many copies."""
    return duration_curve_frame(item_facts(spark, folder), "Property", "Load")


def trace_density(spark: SparkSession, folder: str) -> DataFrame:
    return density(trace_points(spark, folder, MIXED, "event_facts"))


def value_density(spark: SparkSession, folder: str) -> DataFrame:
    return density(event_facts(spark, folder), "BZ", "Value")


def edge_density(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers 1 to 50: every value lies on the edge of a bin."""
    return density(item_facts(spark, folder), "BZ", "Load")


def stacked(spark: SparkSession, folder: str) -> DataFrame:
    points = trace_points(spark, folder, STACK, "event_facts")
    return stacked_area(points, range(len(STACK)))


def stacked_items(spark: SparkSession, folder: str) -> DataFrame:
    specs = item_specs("sum", "native")
    return stacked_area(trace_points(spark, folder, specs, "item_facts"), range(len(specs)))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    facts = event_facts(spark, folder).withColumn("__source_file", F.col("BZ"))
    return (
        facts.select(
            series_label(["__source_file", "PEMMDB_TECHNOLOGY", "WS"]).alias("three"),
            series_label(["Property"]).alias("one"),
            series_label([]).alias("none"),
        )
        .groupBy("three", "one", "none")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def ordered_labels(spark: SparkSession, folder: str) -> DataFrame:
    facts = event_facts(spark, folder)
    mixed_case = F.when(F.col("WS") < 2, F.upper("BZ")).otherwise(F.col("BZ"))
    return series_order(facts.withColumn("series", mixed_case), "series")


def first_technologies(spark: SparkSession, folder: str) -> DataFrame:
    return first_technology(event_facts(spark, folder), "BZ", "PEMMDB_TECHNOLOGY", "Datetime")


def duration_sql(series: str, percent: str, keep: str = "true") -> str:
    rank = f"row_number() over (partition by {series} order by value desc nulls last)"
    return (
        f"select {series}, {rank} as rank,"
        f" {rank}::double / count(*) over (partition by {series}) * 100.0 as {percent},"
        f" value from points where {keep}"
    )


def frame_sql(facts: str, series: str, name: str, value: str) -> str:
    return with_facts(
        facts,
        f"""points as (select {series} as "{name}", "{value}" as value from {facts}),
done as ({duration_sql(f'"{name}"', "duration_percent", "value is not null")})
select "{name}", rank, duration_percent, value as "{value}" from done""",
    )


def density_sql(series: str) -> str:
    return f"""
stats as (select {series}, min(value) as lo0, max(value) as hi0, count(value) as n
  from points where value is not null group by 1),
shape as (select {series}, n, case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo,
  case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi,
  (case when n >= 100 then 100 else greatest(10, n) end)::int as bins from stats),
edges as (select {series}, n, lo, hi, bins, unnest(generate_series(0, bins - 1))::int as bin
  from shape),
bounds as (select {series}, n, bin, bins, bin * ((hi - lo) / bins) + lo as e0,
  case when bin + 1 = bins then hi else (bin + 1) * ((hi - lo) / bins) + lo end as e1 from edges),
inside as (select b.{series}, b.bin, count(p.value) as c from bounds b left join points p
  on p.{series} = b.{series} and p.value >= b.e0
    and (p.value < b.e1 or (b.bin = b.bins - 1 and p.value = b.e1)) group by 1, 2)
select {series}, bin, (e0 + e1) / 2 as x, c / (e1 - e0) / n as y
from bounds join inside using ({series}, bin)"""


def stack_sql(points: str) -> str:
    return f"""points as ({points}),
cells as (select trace_id, time, coalesce(sum(value), 0) as value from points group by 1, 2),
grid as (select trace_id, time from (select distinct trace_id from cells) t,
  (select distinct time from cells) x),
filled as (select trace_id, time, coalesce(value, 0) as value
  from grid left join cells using (trace_id, time))
select trace_id, time, value,
  coalesce(sum(value) over (partition by time order by trace_id
    rows between unbounded preceding and 1 preceding), 0) as y0,
  sum(value) over (partition by time order by trace_id) as y1 from filled"""


def label_part(column: str, shown: str | None = None) -> str:
    return f"'{shown or column}=' || coalesce(\"{column}\", 'NA')"


QUERIES = {
    "duration_curve": duration,
    "duration_curve_raw": duration_units,
    "duration_curve_raw_whole": duration_whole,
    "duration_curve_series": duration_series,
    "duration_curve_scaled": duration_scaled,
    "duration_curve_tied": duration_tied,
    "density": trace_density,
    "density_values": value_density,
    "density_edges": edge_density,
    "stacked_area": stacked,
    "stacked_area_native": stacked_items,
    "series_label": labels,
    "series_order": ordered_labels,
    "first_technology": first_technologies,
}

ORACLES = {
    "duration_curve": with_facts(
        "event_facts",
        f'points as ({points_sql(MIXED, "event_facts", steps=True)})\n'
        + duration_sql("trace_id", "x"),
    ),
    "duration_curve_raw": with_facts(
        "event_facts",
        """points as (select "WS"::int as trace_id, "Value" as value from event_facts
  where "BZ" = 'view' and "WS" < 3)\n"""
        + duration_sql("trace_id", "x"),
    ),
    "duration_curve_raw_whole": with_facts(
        "event_facts",
        """points as (select ("WS" * 4 + list_position(['click', 'view', 'purchase', 'error'], "BZ") - 1)::int
    as trace_id, "Value" as value from event_facts
  where "BZ" in ('click', 'view', 'purchase', 'error'))\n"""
        + duration_sql("trace_id", "x"),
    ),
    "duration_curve_series": frame_sql(
        "event_facts",
        f"{label_part('BZ')} || ' | ' || {label_part('PEMMDB_TECHNOLOGY')}",
        "series",
        "Value",
    ),
    "duration_curve_scaled": frame_sql("item_facts", '"BZ"', "BZ", "Value"),
    "duration_curve_tied": frame_sql("item_facts", '"Property"', "Property", "Load"),
    "density": with_facts(
        "event_facts",
        f'points as ({points_sql(MIXED, "event_facts", steps=True)}),' + density_sql("trace_id"),
    ),
    "density_values": with_facts(
        "event_facts",
        'points as (select "BZ", "Value" as value from event_facts),' + density_sql('"BZ"'),
    ),
    "density_edges": with_facts(
        "item_facts",
        'points as (select "BZ", "Load" as value from item_facts),' + density_sql('"BZ"'),
    ),
    "stacked_area": with_facts(
        "event_facts", stack_sql(points_sql(STACK, "event_facts", steps=True))
    ),
    "stacked_area_native": with_facts(
        "item_facts", stack_sql(points_sql(item_specs("sum", "native"), "item_facts"))
    ),
    "series_label": with_facts(
        "event_facts",
        f"""named as (select {label_part('BZ', 'File')} || ' | ' || {label_part('PEMMDB_TECHNOLOGY')}
    || ' | ' || 'WS=' || "WS" as three,
  {label_part('Property')} as one, 'Gesamt' as none from event_facts)
select three, one, none, count(*) as rows from named group by all""",
    ),
    "series_order": with_facts(
        "event_facts",
        """cased as (select case when "WS" < 2 then upper("BZ") else "BZ" end as label from event_facts)
select distinct label from cased order by lower(label), label""",
    ),
    "first_technology": with_facts(
        "event_facts",
        """firsts as (select "BZ", min_by("PEMMDB_TECHNOLOGY", "Datetime") as technology
  from event_facts where "PEMMDB_TECHNOLOGY" is not null group by 1)
select * from firsts""",
    ),
}
