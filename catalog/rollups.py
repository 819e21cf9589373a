"""Roll-ups: units to technologies, and technologies to clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import event_facts, item_facts
from catalog.traces import with_facts
from tracemill.functions.labels import technology_clusters
from tracemill.operators.rollup import collapse_units, rollup_cluster, rollup_technology

ITEM_KEYS = '"__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "Sample", "WS", "Datetime"'
EVENT_KEYS = '"__run_key", "PEMMDB_TECHNOLOGY", "Property", "BZ", "WS", "Datetime"'


def technologies(spark: SparkSession, folder: str) -> DataFrame:
    return rollup_technology(item_facts(spark, folder))


def technologies_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    daily = event_facts(spark, folder).withColumn(
        "Datetime", F.date_trunc("day", "Datetime").cast("timestamp_ntz")
    )
    return rollup_technology(daily, time_columns=["Datetime"])


def units_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    source = F.concat(F.col("BZ"), F.lit(".parquet"))
    return collapse_units(item_facts(spark, folder).withColumn("__source_file", source))


# Technology names as they appear in files, with the cluster of each.
NAMES = {
    "PROMO": ("Gas/CCGT new", "Gas"),
    "ECONOMY": ("hard_coal-old 1", "Coal"),
    "LARGE": ("  Wind   ONSHORE ", "Wind"),
    "STANDARD": ("Open_loop pumping", "PSP"),
    "MEDIUM": ("fuel cell", "Fuel_Cell"),
    "SMALL": ("perpetual motion", None),
}


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    facts = item_facts(spark, folder)
    renamed = F.lit(None).cast("string")
    for kind, (name, _) in NAMES.items():
        renamed = F.when(F.col("PEMMDB_TECHNOLOGY") == kind, name).otherwise(renamed)
    named = technology_clusters(facts.withColumn("PEMMDB_TECHNOLOGY", renamed), "PEMMDB_TECHNOLOGY")
    monthly = named.withColumn("Datetime", F.trunc("Datetime", "month").cast("timestamp_ntz"))
    return rollup_cluster(monthly, "cluster")


_CLUSTER_CASE = " ".join(
    f"when '{kind}' then '{cluster}'" for kind, (_, cluster) in NAMES.items() if cluster
)

QUERIES = {
    "rollup_technology": technologies,
    "rollup_technology_nulls": technologies_with_nulls,
    "rollup_unit_collapse": units_collapsed,
    "rollup_cluster": clusters,
}
ORACLES = {
    "rollup_technology": with_facts(
        "item_facts",
        f"""done as (select {ITEM_KEYS}, coalesce(sum("Value"), 0) as "Value",
  coalesce(sum("Load"), 0) as "Load" from item_facts group by {ITEM_KEYS})
select * from done""",
    ),
    "rollup_technology_nulls": with_facts(
        "event_facts",
        f"""daily as (select * replace (date_trunc('day', "Datetime") as "Datetime") from event_facts)
select {EVENT_KEYS}, coalesce(sum("Value"), 0) as "Value" from daily group by {EVENT_KEYS}""",
    ),
    "rollup_unit_collapse": with_facts(
        "item_facts",
        f"""tagged as (select *, "BZ" || '.parquet' as "__source_file" from item_facts)
select {ITEM_KEYS}, "__source_file", coalesce(sum("Value"), 0) as "Value",
  coalesce(sum("Load"), 0) as "Load" from tagged group by {ITEM_KEYS}, "__source_file" """,
    ),
    "rollup_cluster": with_facts(
        "item_facts",
        f"""named as (select * replace (date_trunc('month', "Datetime")::timestamp as "Datetime"),
  case "PEMMDB_TECHNOLOGY" {_CLUSTER_CASE} end as cluster from item_facts)
select "__run_key", cluster, "Property", "BZ", "Sample", "WS", "Datetime",
  sum("Value") as "Value", sum("Load") as "Load"
from named group by "__run_key", cluster, "Property", "BZ", "Sample", "WS", "Datetime" """,
    ),
}
