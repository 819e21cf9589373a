"""Parsing and profiling of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import event_facts, item_facts, table
from catalog.traces import with_facts
from tracemill.functions.values import nan_to_null, sum_or_zero
from tracemill.operators.clean import fact_table, with_number, with_time
from tracemill.operators.profile import (
    column_profile,
    datetime_bounds,
    detect_time_columns,
    filled_counts,
    schema_profile,
    wide_profile,
)
from tracemill.session import rows_frame


def hint_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH.mm")


def iso_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")


def hint_times(spark: SparkSession, folder: str) -> DataFrame:
    """One text in ten is spoilt: the hint layout still fits enough."""
    text = F.when(F.col("event_id") % 10 == 0, "no time").otherwise(hint_text())
    texts = table(spark, folder, "events").select("event_id", text.alias("time"))
    return with_time(texts, "time")


def fallback_times(spark: SparkSession, folder: str) -> DataFrame:
    """One text in three is in the hint layout, the others are ISO times."""
    text = F.when(F.col("event_id") % 3 == 0, hint_text()).otherwise(iso_text())
    texts = table(spark, folder, "events").select("event_id", text.alias("time"))
    return with_time(texts, "time")


def slashed_times(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(
        F.date_format("ts", "d/M/yyyy H:mm")
    )
    texts = table(spark, folder, "events").select("event_id", text.alias("time"))
    return with_time(texts, "time")


def formatted_times(pattern: str):
    """Times as texts in one layout; one in seven is missing."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        text = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", pattern))
        return with_time(table(spark, folder, "events").select("event_id", text.alias("time")), "time")

    return query


# What each layout keeps of a time.
FORMATS = {
    "parse_dash_datetime": ("dd-MM-yyyy HH:mm", "minute"),
    "parse_dot_year_first": ("yyyy.MM.dd HH:mm", "minute"),
    "parse_month_name": ("dd MMM yyyy HH:mm", "minute"),
    "parse_fraction": ("yyyy/MM/dd HH:mm:ss.SSS", "millisecond"),
    "parse_half_days": ("yyyy-MM-dd hh:mm a", "minute"),
}


# Layouts that no list names, one for each run; what is kept of a time is its minute.
UNLISTED = ("MMM d yyyy H:mm", "dd.MM.yy HH:mm", "yyyyMMdd HHmm", "EEE, dd MMM yyyy HH:mm:00")


def inferred_times(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose layouts are found from the shapes of their texts; one text in nine is none."""
    run = F.col("user_id") % len(UNLISTED)
    text = F.coalesce(
        *[F.when(run == i, F.date_format("ts", pattern)) for i, pattern in enumerate(UNLISTED)]
    )
    rows = table(spark, folder, "events").select(
        "event_id", run.alias("run"), F.when(F.col("event_id") % 9 == 0, "soon").otherwise(text).alias("time")
    )
    return with_time(rows, "time", "run")


def coerced(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    text = (
        F.when(key % 11 == 0, "no number")
        .when(key % 13 == 0, "5d")
        .when(key % 17 == 0, " 12 ")
        .when(key % 19 == 0, "-1.5e3")
        .when(key % 23 == 0, "nan")
        .otherwise(key.cast("string"))
    )
    texts = table(spark, folder, "events").select("event_id", text.alias("value"))
    return with_number(texts, "value")


def nulls_united(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over values that may be null or NaN, groups of nulls included."""
    value = nan_to_null(F.col("Value"))
    facts = event_facts(spark, folder).withColumn("tens", F.col("Value").isNull())
    return facts.groupBy("BZ", "tens").agg(
        sum_or_zero(value).alias("total"),
        F.avg(value).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a bad time, or with a text that is no number, are dropped."""
    key = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(key % 10 == 0, "no time").otherwise(hint_text()).alias("Datetime"),
        F.when(key % 7 == 0, "n/a").otherwise(key.cast("string")).alias("Value"),
    )
    return fact_table(rows)


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("day")
    )
    found = datetime_bounds(texts, "day").withColumn("column", F.lit("text"))
    native = datetime_bounds(table(spark, folder, "lineitem"), "l_shipdate")
    absent = datetime_bounds(table(spark, folder, "lineitem"), "no_such_column")
    found = found.unionByName(native.withColumn("column", F.lit("native"))).unionByName(
        absent.withColumn("column", F.lit("absent"))
    )
    days = {name: F.col(name).cast("string") for name in ("min_date", "max_date")}
    return found.withColumns(days)


def schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema with the filled rows of every column."""
    items = table(spark, folder, "lineitem")
    known = schema_profile(items).join(filled_counts(items), "column")
    return known.select("ordinal", "column", "type", "is_time", "is_numeric", "rows", "filled")


def time_columns(spark: SparkSession, folder: str) -> DataFrame:
    """By name ``day_hour``, by content ``seen``; ``code`` is only half times."""
    half = F.when(F.col("event_id") % 2 == 0, hint_text()).otherwise("x")
    rows = table(spark, folder, "events").select(
        F.hour("ts").alias("day_hour"),
        F.col("event_type").alias("BZ"),
        iso_text().alias("seen"),
        half.alias("code"),
        F.col("props"),
    )
    found = detect_time_columns(rows)
    known = rows_frame(spark, list(enumerate(found)), "ordinal int, column string")
    return known.join(filled_counts(rows), "column").select("ordinal", "column", "filled")


def profile(spark: SparkSession, folder: str) -> DataFrame:
    names = ["Scenario", "Sample", "BZ", "WS", "Property", "PEMMDB_TECHNOLOGY", "Unit Name"]
    found = column_profile(item_facts(spark, folder), names)
    examples = F.coalesce(F.array_join("examples", ","), F.lit(""))
    return found.withColumn("examples", examples)


WIDE = ("id", "l_comment_like", "l_quantity", "none", "nothing", "l_shipdate")


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """A column of one value per row beside others, one of nulls, and one that is missing."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        key.alias("id"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("é"), F.reverse(key))).alias("l_comment_like"),
        "l_quantity",
        F.lit(None).cast("string").alias("none"),
        F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"),
    )
    found = wide_profile(rows, WIDE)
    return found.withColumn("examples", F.coalesce(F.array_join("examples", ","), F.lit("")))


def _wide_sql() -> str:
    values = {
        "id": "l_orderkey || '-' || l_linenumber",
        "l_comment_like": "case when l_linenumber > 1 then 'é' || reverse(l_orderkey || '-' || l_linenumber) end",
        "l_quantity": "l_quantity::varchar",
        "none": "null::varchar",
        "nothing": "null::varchar",
        "l_shipdate": "l_shipdate::date::varchar",
    }
    parts = [
        f"""select {i} as ordinal, '{name}' as "column", {name == 'nothing'} as missing,
  count(*) as rows, count(distinct v) as distinct_values,
  coalesce((select string_agg(v, ',' order by v) from (select distinct v from t{i}
    where v is not null order by v limit 10)), '') as examples from t{i}"""
        for i, name in enumerate(WIDE)
    ]
    made = (f"t{i} as (select {values[name]} as v from lineitem)" for i, name in enumerate(WIDE))
    return f"with {', '.join(made)} {' union all '.join(parts)}"


def _profile_sql() -> str:
    parts = [
        "select 0 as ordinal, 'Scenario' as \"column\", true as missing,"
        " (select count(*) from item_facts) as rows, 0 as distinct_values, '' as examples"
    ]
    for i, name in enumerate(
        ("Sample", "BZ", "WS", "Property", "PEMMDB_TECHNOLOGY", "Unit Name"), start=1
    ):
        parts.append(
            f"select {i}, '{name}', false, (select count(*) from item_facts), count(v),"
            " coalesce(array_to_string((list(v order by v))[1:10], ','), '')"
            f' from (select distinct "{name}"::varchar as v from item_facts where "{name}" is not null)'
        )
    return with_facts("item_facts", f"done as ({' union all '.join(parts)})\nselect * from done")


QUERIES = {name: formatted_times(pattern) for name, (pattern, _) in FORMATS.items()} | {
    "parse_hint_datetime": hint_times,
    "parse_fallback_datetime": fallback_times,
    "parse_slash_datetime": slashed_times,
    "parse_inferred_layout": inferred_times,
    "coerce_numeric": coerced,
    "null_unification": nulls_united,
    "valid_time_filter": valid_rows,
    "datetime_bounds": bounds,
    "schema_profile": schema,
    "time_column_detect": time_columns,
    "column_profile": profile,
    "column_profile_wide": wide,
}
_SCHEMA = [
    ("l_orderkey", "bigint", False, True),
    ("l_partkey", "bigint", False, True),
    ("l_suppkey", "bigint", False, True),
    ("l_linenumber", "int", False, True),
    ("l_quantity", "double", False, True),
    ("l_extendedprice", "double", False, True),
    ("l_discount", "double", False, True),
    ("l_tax", "double", False, True),
    ("l_returnflag", "string", False, False),
    ("l_linestatus", "string", False, False),
    ("l_shipdate", "timestamp_ntz", True, False),
]
ORACLES = {
    name: f"""select event_id,
  case when event_id % 7 <> 0 then date_trunc('{unit}', ts) end as time from events"""
    for name, (_, unit) in FORMATS.items()
} | {
    "parse_hint_datetime": """select event_id,
  case when event_id % 10 <> 0 then date_trunc('minute', ts) end as time from events""",
    "parse_fallback_datetime": """select event_id,
  case when event_id % 3 <> 0 then date_trunc('second', ts) end as time from events""",
    "parse_slash_datetime": """select event_id,
  case when event_id % 7 <> 0 then date_trunc('minute', ts) end as time from events""",
    "parse_inferred_layout": """select event_id, user_id % 4 as run,
  case when event_id % 9 <> 0 then date_trunc('minute', ts) end as time from events""",
    "coerce_numeric": """select event_id, case when event_id % 17 = 0 then 12.0::double
  when event_id % 19 = 0 then -1500.0::double else event_id::double end as value from events
where event_id % 11 <> 0 and event_id % 13 <> 0 and (event_id % 17 = 0 or event_id % 19 = 0
  or event_id % 23 <> 0)""",
    "null_unification": """with v as (select event_type as "BZ", event_id % 17 = 0 as tens,
  case when event_id % 17 <> 0 and event_id % 19 <> 0 then round(value * 100) end as v from events)
select "BZ", tens, coalesce(sum(v), 0) as total, avg(v) as mean, min(v) as least, max(v) as most
from v group by all""",
    "valid_time_filter": """select event_id, date_trunc('minute', ts) as "Datetime",
  event_id::double as "Value" from events where event_id % 10 <> 0 and event_id % 7 <> 0""",
    "datetime_bounds": """select 'text' as "column", min(o_orderdate)::date::varchar as min_date,
  max(o_orderdate)::date::varchar as max_date from orders
union all select 'native', min(l_shipdate)::date::varchar,
  max(l_shipdate)::date::varchar from lineitem
union all select 'absent', null, null""",
    "schema_profile": " union all ".join(
        f"select {i} as ordinal, '{name}' as \"column\", '{kind}' as \"type\", {time} as is_time,"
        f" {number} as is_numeric, count(*) as rows, count({name}) as filled from lineitem"
        for i, (name, kind, time, number) in enumerate(_SCHEMA)
    ),
    "time_column_detect": """with share as (
  select count(ts) as filled, avg(case when event_id % 2 = 0 then 1.0 else 0.0 end) as half from events)
select 0 as ordinal, 'day_hour' as "column", filled from share
union all select 1, 'seen', filled from share
union all select 2, 'code', filled from share where half > 0.9""",
    "column_profile": _profile_sql(),
    "column_profile_wide": _wide_sql(),
}
