"""Traces: matching, buckets, raw rows, reports, labels, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import EVENT_FACTS, ITEM_FACTS, event_facts, item_facts
from tracemill.operators.clean import fact_table
from tracemill.operators.curves import line
from tracemill.operators.selector import selector_index, selector_tree
from tracemill.plans.evaluate import evaluate, report, summary, with_steps
from tracemill.plans.traces import (
    TraceSpec,
    first_of_label,
    specs_frame,
    trace_label,
    validate,
    with_defaults,
    without_labels,
)

BUCKET_SQL = {
    "hour": "date_trunc('hour', {t})",
    "day": "date_trunc('day', {t})",
    "week": "date_trunc('week', {t} - interval 1 day) + interval 1 day",
    "month": "date_trunc('month', {t})",
    "native": "{t}",
}
LENGTH_SQL = {"hour": "1 hour", "day": "1 day", "week": "7 day", "month": "1 month"}
FUNCTION_SQL = {
    "sum": "coalesce(sum(v), 0)",
    "mean": "avg(v)",
    "min": "min(v)",
    "max": "max(v)",
}
ROLLED = '"__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "WS", "Datetime"'


def quote(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def rows_sql(
    spec: TraceSpec, facts: str, unit_detail: bool, start: str | None, end: str | None
) -> str:
    """``t, v`` of the rows of one trace."""
    keep = [f'"WS" = {float(spec.ws)}', f'"BZ" = {quote(spec.area)}']
    for column, value in (
        ("__run_key", spec.run),
        ("Property", spec.prop),
        ("PEMMDB_TECHNOLOGY", spec.technology),
        ("Unit Name", spec.unit),
    ):
        if value is not None:
            keep.append(f'"{column}" = {quote(value)}')
    if start:
        keep.append(f"\"Datetime\" >= timestamp '{start}'")
    if end:
        keep.append(f"\"Datetime\" < timestamp '{end}' + interval 1 day")
    where = " and ".join(keep)
    if unit_detail:
        return f'select "Datetime" as t, "Value" as v from {facts} where {where}'
    sample = ', "Sample"' if facts == "item_facts" else ""
    return (
        f'select "Datetime" as t, coalesce(sum("Value"), 0) as v from {facts}'
        f" where {where} group by {ROLLED}{sample}"
    )


def points_sql(
    specs: Sequence[TraceSpec],
    facts: str,
    unit_detail: bool = False,
    steps: bool = False,
    start: str | None = None,
    end: str | None = None,
) -> str:
    """Body of a CTE with ``trace_id, time, value`` of all traces."""
    parts = []
    for i, spec in enumerate(specs):
        rows = rows_sql(spec, facts, unit_detail, start, end)
        if spec.aggregation == "none":
            parts.append(f"select {i} as trace_id, t as time, v as value from ({rows})")
            continue
        resolution = spec.resolution or "native"
        bucket = BUCKET_SQL[resolution].format(t="t")
        sums = (
            f"select {i} as trace_id, {bucket} as time,"
            f" {FUNCTION_SQL[spec.aggregation or 'sum']} as value from ({rows}) group by 1, 2"
        )
        if steps and resolution != "native":
            after = f"interval {LENGTH_SQL[resolution]} - interval 1 microsecond"
            sums = (
                f"select trace_id, unnest([time, time + {after}]) as time, value from ({sums})"
            )
        parts.append(sums)
    return "\n  union all ".join(parts)


def with_facts(facts: str, rest: str) -> str:
    ctes = EVENT_FACTS if facts == "event_facts" else ITEM_FACTS
    return f"with {ctes.strip()},\n{rest}"


def trace_sql(specs, facts, **options) -> str:
    body = points_sql(specs, facts, **options)
    return with_facts(facts, f"points as ({body})\nselect trace_id, time, value from points")


def facts_of(spark: SparkSession, folder: str, facts: str) -> DataFrame:
    made = event_facts if facts == "event_facts" else item_facts
    return fact_table(made(spark, folder))


def trace_query(specs, facts, steps=False, **options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        points = evaluate(facts_of(spark, folder, facts), specs, **options).points
        if steps:
            points = with_steps(points)
        return points.select("trace_id", "time", "value")

    return query


def item_specs(aggregation: str, resolution: str = "native") -> list[TraceSpec]:
    how = {"aggregation": aggregation, "resolution": resolution}
    return [
        TraceSpec("F", 1, "A", "dispatch", "PROMO", **how),
        TraceSpec("F", "2.0", "R", "dispatch", **how),
        TraceSpec("O", 3, "N", "import", **how),
        TraceSpec("O", 1, "N", **how),
    ]


def event_specs(aggregation: str, resolution: str) -> list[TraceSpec]:
    how = {"aggregation": aggregation, "resolution": resolution}
    return [
        TraceSpec("run_0", 0, "click", "generation", "tech_1", **how),
        TraceSpec("run_1", "3", "view", "generation", **how),
        TraceSpec("run_1", 1.0, "error", "load", **how),
        TraceSpec(None, 2, "signup", **how),
    ]


MIXED = [
    TraceSpec("run_0", 0, "click", "generation", "tech_1", None, "sum", "hour"),
    TraceSpec("run_0", 0, "click", "generation", "tech_1", None, "mean", "day"),
    TraceSpec("run_0", 0, "click", "generation", "tech_1", None, "max", "day"),
    TraceSpec("run_1", 3, "view", "generation", None, None, "min", "week"),
    TraceSpec("run_1", 3, "view", "generation", None, None, None, "month"),
    TraceSpec("run_1", 1, "purchase", "load"),
    TraceSpec("run_0", 2, "error", None, None, None, "none"),
    TraceSpec("run_1", 0, "error", "load", None, None, "sum", "day"),
]
UNITS = [
    TraceSpec("run_0", 0, "click", "generation", "tech_3", "u8", "sum", "day"),
    TraceSpec("run_1", 3, "view", "generation", "tech_1", "u11", "mean", "week"),
    TraceSpec("run_1", 3, "view", "generation", "tech_1", "u11", "none"),
    TraceSpec("run_0", 2, "error", "generation", "tech_0", "u10", "max", "month"),
]
RAW_SPECS = [
    TraceSpec("run_0", 2, "error", None, None, None, "none"),
    TraceSpec("run_0", 0, "click", "load", None, None, "none"),
    TraceSpec("run_1", 1, "view", "generation", "tech_2", None, "none"),
]
# Raw traces are refused from here on in the two queries about the limit.
RAW_LIMIT = 200
DATES = {"start": "2024-01-08", "end": "2024-01-15"}
WHOLE_LIMITED = [*RAW_SPECS, *MIXED]

QUERIES = {}
ORACLES = {}

for _how in ("sum", "mean", "min", "max"):
    QUERIES[f"trace_native_{_how}"] = trace_query(item_specs(_how), "item_facts", unit_detail=True)
    ORACLES[f"trace_native_{_how}"] = trace_sql(item_specs(_how), "item_facts", unit_detail=True)
for _name, _resolution, _how in (
    ("trace_hour", "hour", "sum"),
    ("trace_day", "day", "mean"),
    ("trace_week_tuesday", "week", "sum"),
    ("trace_month", "month", "max"),
):
    QUERIES[_name] = trace_query(event_specs(_how, _resolution), "event_facts")
    ORACLES[_name] = trace_sql(event_specs(_how, _resolution), "event_facts")
QUERIES["trace_week_steps"] = trace_query(event_specs("sum", "week"), "event_facts", steps=True)
ORACLES["trace_week_steps"] = trace_sql(event_specs("sum", "week"), "event_facts", steps=True)
QUERIES["trace_month_steps"] = trace_query(item_specs("mean", "month"), "item_facts", steps=True)
ORACLES["trace_month_steps"] = trace_sql(item_specs("mean", "month"), "item_facts", steps=True)
QUERIES["traces_mixed"] = trace_query(MIXED, "event_facts", steps=True)
ORACLES["traces_mixed"] = trace_sql(MIXED, "event_facts", steps=True)
QUERIES["trace_units"] = trace_query(UNITS, "event_facts", unit_detail=True)
ORACLES["trace_units"] = trace_sql(UNITS, "event_facts", unit_detail=True)
QUERIES["trace_date_range"] = trace_query(event_specs("sum", "day"), "event_facts", **DATES)
ORACLES["trace_date_range"] = trace_sql(event_specs("sum", "day"), "event_facts", **DATES)
QUERIES["rollup_then_mean"] = trace_query(item_specs("mean", "month"), "item_facts")
ORACLES["rollup_then_mean"] = trace_sql(item_specs("mean", "month"), "item_facts")


def trace_raw(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluate(facts_of(spark, folder, "event_facts"), RAW_SPECS, raw_limit=None).points
    return line(points.select("trace_id", "time", "value"))


QUERIES["trace_raw"] = trace_raw
ORACLES["trace_raw"] = trace_sql(RAW_SPECS, "event_facts") + " order by trace_id, time"


def trace_raw_limit(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder, "event_facts")
    points = evaluate(facts, RAW_SPECS, raw_limit=RAW_LIMIT).points
    return points.select("trace_id", "time", "value")


QUERIES["trace_raw_limit"] = trace_raw_limit
ORACLES["trace_raw_limit"] = (
    trace_sql(RAW_SPECS, "event_facts")
    + f" qualify count(*) over (partition by trace_id) <= {RAW_LIMIT}"
)


def line_series(spark: SparkSession, folder: str) -> DataFrame:
    points = evaluate(facts_of(spark, folder, "item_facts"), item_specs("sum", "week")).points
    return line(with_steps(points)).select("trace_id", "time", "value")


QUERIES["line_series"] = line_series
ORACLES["line_series"] = (
    trace_sql(item_specs("sum", "week"), "item_facts", steps=True) + " order by trace_id, time"
)


def label_sql(spec: TraceSpec) -> str:
    parts = [spec.run or spec.scenario or "?", f"WS {spec.ws}", spec.area]
    if spec.prop is not None:
        parts.append(spec.prop)
        if spec.technology is not None:
            parts.append(spec.technology)
    if spec.unit:
        parts.append(spec.unit)
    label = " | ".join(str(part) for part in parts)
    if spec.aggregation == "none":
        label += " [raw]"
    elif spec.aggregation:
        label += f" [{spec.aggregation}/{spec.resolution or 'native'}]"
    return quote(label)


def reported(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder, "event_facts")
    result = evaluate(facts, WHOLE_LIMITED, raw_limit=RAW_LIMIT)
    return report(result, with_steps(result.points))


def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    row = summary(reported(spark, folder))
    return row.select("traces", "points", F.array_join("missing", "; ").alias("missing"))


_ASKED = " union all ".join(
    f"select {i} as trace_id, {label_sql(s)} as label, {s.aggregation == 'none'} as raw"
    for i, s in enumerate(WHOLE_LIMITED)
)
_REPORT = with_facts(
    "event_facts",
    f"""points as ({points_sql(WHOLE_LIMITED, "event_facts", steps=True)}),
asked as ({_ASKED}),
reported as (
  select trace_id, label,
    case when any_value(raw) and count(time) > {RAW_LIMIT} then 0 else count(time) end as points,
    case when any_value(raw) and count(time) > {RAW_LIMIT} then 'too_large'
      when count(time) = 0 then 'missing' else 'ok' end as status
  from asked left join points using (trace_id) group by all)
""",
)
QUERIES["trace_missing"] = reported
ORACLES["trace_missing"] = _REPORT + "select trace_id, label, points, status from reported"
QUERIES["trace_summary"] = trace_summary
ORACLES["trace_summary"] = _REPORT + (
    "select count(*) as traces, sum(points)::bigint as points, coalesce(string_agg(label, '; '"
    " order by trace_id) filter (status = 'missing'), '') as missing from reported"
)

# Trace lists as typed in by a user, checked against the events.
TYPED = [
    TraceSpec("run_0", 0, "click", "generation", "tech_1", None, "sum", "day"),
    TraceSpec("run_0", "0", "click", "generation", "tech_1", None, "sum", "day"),
    TraceSpec("run_0", 0, "click", "generation", "tech_1", None, "none", "day"),
    TraceSpec("run_0", 0, "click", "generation"),
    TraceSpec("run_0", 0, "click", "load", "tech_1"),
    TraceSpec("run_0", 0, "click", "load"),
    TraceSpec("run_0", 0, "click", "load", None, "u8"),
    TraceSpec("run_0", 0, "click", "generation", "tech_3", "u8"),
    TraceSpec("run_1", 0, "click", "generation", "tech_3"),
    TraceSpec(None, 0, "click", "load"),
    TraceSpec("run_0", 0, "click"),
    TraceSpec(None, 2, "view", "load", None, None, "max", None, "a/b.parquet"),
]


def typed(spark: SparkSession) -> DataFrame:
    return specs_frame(spark, TYPED)


def trace_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the typed traces with the number of rows they select."""
    specs = [spec for spec in TYPED if spec.run]
    facts = facts_of(spark, folder, "event_facts")
    result = evaluate(facts, [_raw(spec) for spec in specs], unit_detail=True, raw_limit=None)
    rows = result.points.groupBy("trace_id").agg(F.count(F.lit(1)).alias("rows"))
    labels = specs_frame(spark, specs).select("trace_id", trace_label().alias("label"))
    return labels.join(rows, "trace_id", "left").select(
        "trace_id", "label", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def _raw(spec: TraceSpec) -> TraceSpec:
    return TraceSpec(
        spec.run, spec.ws, spec.area, spec.prop, spec.technology, spec.unit, "none"
    )


QUERIES["trace_labels"] = trace_labels
ORACLES["trace_labels"] = with_facts(
    "event_facts",
    "sizes as ("
    + " union all ".join(
        f"select {i} as trace_id, {label_sql(spec)} as label,"
        f" (select count(*) from ({rows_sql(_raw(spec), 'event_facts', True, None, None)})) as rows"
        for i, spec in enumerate(spec for spec in TYPED if spec.run)
    )
    + ")\nselect * from sizes",
)


def validation(unit_detail: bool):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tree = selector_tree(selector_index(event_facts(spark, folder)))
        checked = validate(typed(spark), tree, unit_detail)
        return checked.select("trace_id", F.coalesce("reason", F.lit("valid")).alias("reason"))

    return query


def validation_sql(unit_detail: bool) -> str:
    def needs(spec: TraceSpec) -> str:
        return (
            f'(select count(*) > 0 from event_facts where "__run_key" = {quote(spec.run)}'
            f' and "WS" = {float(spec.ws)} and "BZ" = {quote(spec.area)}'
            f' and "Property" = {quote(spec.prop)} and "PEMMDB_TECHNOLOGY" is not null)'
        )

    rows = " union all ".join(
        f"select {i} as trace_id, {quote(s.run)} as run, {quote(s.prop)} as prop,"
        f" {quote(s.technology)} as tech, {quote(s.unit)} as unit, {needs(s)} as needs"
        for i, s in enumerate(TYPED)
    )
    if unit_detail:
        last = "when not needs then 'unit_needs_technology' when unit is null then 'unit_required'"
    else:
        last = "when unit is not null then 'unit_not_allowed'"
    return with_facts(
        "event_facts",
        f"""typed as ({rows})
select trace_id, case when run is null or prop is null then 'incomplete'
  when needs and tech is null then 'technology_required'
  when not needs and tech is not null then 'technology_not_allowed'
  {last} else 'valid' end as reason from typed""",
    )


for _detail, _name in ((False, "trace_validation"), (True, "trace_validation_units")):
    QUERIES[_name] = validation(_detail)
    ORACLES[_name] = validation_sql(_detail)


def areas_as_traces(spark: SparkSession, folder: str) -> DataFrame:
    """A trace list grown from the data: one trace per dimension combination."""
    index = selector_index(event_facts(spark, folder).drop("Unit Name", "__run_key"))
    order = F.xxhash64("BZ", "WS", "Property", "PEMMDB_TECHNOLOGY")
    return index.select(
        order.alias("trace_id"),
        F.lit("run").alias("run"),
        F.lit(None).cast("string").alias("scenario"),
        # Scenarios 0 and 2, and 1 and 3, get the same label.
        (F.col("WS") % 2).cast("int").cast("string").alias("ws"),
        F.col("WS").cast("int").alias("scenario_number"),
        F.col("BZ").alias("area"),
        F.col("Property").alias("property"),
        F.col("PEMMDB_TECHNOLOGY").alias("technology"),
        F.lit(None).cast("string").alias("unit"),
        F.when(F.col("WS") < 2, F.lit(None)).otherwise("sum").alias("aggregation"),
        F.lit(None).cast("string").alias("resolution"),
    )


def labelled_areas(spark: SparkSession, folder: str) -> DataFrame:
    specs = with_defaults(areas_as_traces(spark, folder))
    return specs.withColumn("label", trace_label())


LABELLED_AREAS = """labelled as (
  select distinct "BZ" as area, "Property" as property, "PEMMDB_TECHNOLOGY" as technology, "WS" as ws,
    concat_ws(' | ', 'run', 'WS ' || ("WS" % 2)::int, "BZ", "Property", "PEMMDB_TECHNOLOGY")
      || ' [sum/native]' as label
  from event_facts)
"""


def trace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Of equal labels the first of the list stays: that of the lower scenario."""
    specs = labelled_areas(spark, folder)
    place = F.col("scenario_number") * 1000 + F.ascii("area")
    kept = first_of_label(specs.withColumn("trace_id", place))
    return kept.select("label", "area", "property", "scenario_number")


REMOVED = ["run | WS 0 | click | load [sum/native]", "run | WS 1 | view | load [sum/native]"]


def trace_remove(spark: SparkSession, folder: str) -> DataFrame:
    kept = without_labels(labelled_areas(spark, folder), REMOVED)
    return kept.select("label", "area", "property")


def trace_defaults(spark: SparkSession, folder: str) -> DataFrame:
    specs = with_defaults(areas_as_traces(spark, folder))
    return specs.groupBy("area", "aggregation", "resolution").agg(
        F.count(F.lit(1)).alias("traces")
    )


QUERIES["trace_dedup"] = trace_dedup
ORACLES["trace_dedup"] = with_facts(
    "event_facts",
    LABELLED_AREAS
    + "select label, area, property, min(ws)::int as scenario_number from labelled group by all",
)
QUERIES["trace_remove"] = trace_remove
ORACLES["trace_remove"] = with_facts(
    "event_facts",
    LABELLED_AREAS
    + "select label, area, property from labelled where label not in ("
    + ", ".join(map(quote, REMOVED))
    + ")",
)
QUERIES["trace_defaults"] = trace_defaults
ORACLES["trace_defaults"] = with_facts(
    "event_facts",
    LABELLED_AREAS
    + "select area, 'sum' as aggregation, 'native' as resolution, count(*) as traces"
    " from labelled group by 1",
)

# Traces without a run: the scenario names a source file or a sample.
LOOSE = [
    TraceSpec(None, 1, "A", "dispatch", None, None, "sum", "month", "runs/F/a.parquet"),
    TraceSpec(None, 2, "N", "import", None, None, "max", "week", "runs/O/a.parquet"),
]
SAMPLES = [
    TraceSpec(None, 1, "A", "dispatch", None, None, "sum", "month", "mc0"),
    TraceSpec(None, 2, "N", "import", None, None, "mean", "week", "mc1"),
]


def scenario_files(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder, "item_facts")
    path = F.concat(F.lit("runs/"), F.col("__run_key"), F.lit("/a.parquet"))
    tagged = facts.withColumn("__source_file", path).drop("__run_key")
    return evaluate(tagged, LOOSE, unit_detail=True).points.select("trace_id", "time", "value")


def scenario_samples(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder, "item_facts").drop("__run_key")
    points = evaluate(facts, SAMPLES, unit_detail=True).points
    return points.select("trace_id", "time", "value")


def scenario_path_without_source(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios that look like paths, over facts that do not name their files."""
    facts = facts_of(spark, folder, "item_facts")
    path = F.concat(F.lit("runs/"), F.col("__run_key"), F.lit("/a.parquet"))
    named = facts.withColumn("Scenario", path).drop("__run_key", "Sample")
    return evaluate(named, LOOSE, unit_detail=True).points.select("trace_id", "time", "value")


def scenario_column_first_filled(spark: SparkSession, folder: str) -> DataFrame:
    """The file column is there but empty, so the sample is what scenarios say."""
    facts = facts_of(spark, folder, "item_facts").drop("__run_key")
    nothing = F.lit(None).cast("string")
    empty = facts.withColumns({"__source_file": nothing, "Scenario": nothing})
    points = evaluate(empty, SAMPLES, unit_detail=True).points
    return points.select("trace_id", "time", "value")


def legacy_technology(spark: SparkSession, folder: str) -> DataFrame:
    facts = facts_of(spark, folder, "item_facts")
    specs = [
        TraceSpec("F", 1, "A", "PROMO", None, None, "sum", "month", is_technology=True),
        TraceSpec("O", 2, "N", "SMALL", None, None, "mean", "week", is_technology=True),
    ]
    return evaluate(facts, specs).points.select("trace_id", "time", "value")


def _loose_sql(column: str, values: Sequence[str], specs: Sequence[TraceSpec]) -> str:
    plain = [
        TraceSpec(None, s.ws, s.area, s.prop, s.technology, s.unit, s.aggregation, s.resolution)
        for s in specs
    ]
    body = points_sql(plain, "loose_facts", unit_detail=True)
    for i, value in enumerate(values):
        mark = f'"BZ" = {quote(plain[i].area)}'
        body = body.replace(mark, f'{mark} and "{column}" = {quote(value)}', 1)
    return with_facts(
        "item_facts",
        f"loose_facts as (select * from item_facts),\npoints as ({body})\n"
        "select trace_id, time, value from points",
    )


QUERIES["scenario_files"] = scenario_files
ORACLES["scenario_files"] = _loose_sql("__run_key", ["F", "O"], LOOSE)
QUERIES["scenario_samples"] = scenario_samples
ORACLES["scenario_samples"] = _loose_sql("Sample", ["mc0", "mc1"], SAMPLES)
QUERIES["scenario_path_without_source"] = scenario_path_without_source
ORACLES["scenario_path_without_source"] = ORACLES["scenario_files"]
QUERIES["scenario_column_first_filled"] = scenario_column_first_filled
ORACLES["scenario_column_first_filled"] = ORACLES["scenario_samples"]
QUERIES["legacy_technology"] = legacy_technology
ORACLES["legacy_technology"] = trace_sql(
    [
        TraceSpec("F", 1, "A", None, "PROMO", None, "sum", "month"),
        TraceSpec("O", 2, "N", None, "SMALL", None, "mean", "week"),
    ],
    "item_facts",
)
