"""Fact tables made from the test tables, in Spark and in SQL.

Values are whole cents, so that sums are exact in both engines whatever the
order of the rows. Some are null or NaN; SQL knows only the null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event: area = kind of event, unit = user."""
    generation = F.col("event_id") % 3 != 0
    user = F.col("user_id")
    cents = F.round(F.col("value") * 100)
    return table(spark, folder, "events").select(
        F.col("ts").alias("Datetime"),
        F.when(F.col("event_id") % 17 == 0, F.lit(None))
        .when(F.col("event_id") % 19 == 0, F.lit(float("nan")))
        .otherwise(cents)
        .alias("Value"),
        F.concat(F.lit("run_"), (user % 2).cast("string")).alias("__run_key"),
        (user % 4).cast("double").alias("WS"),
        F.col("event_type").alias("BZ"),
        F.when(generation, "generation").otherwise("load").alias("Property"),
        F.when(generation, F.concat(F.lit("tech_"), (user % 5).cast("string"))).alias(
            "PEMMDB_TECHNOLOGY"
        ),
        F.when(generation, F.concat(F.lit("u"), user.cast("string"))).alias("Unit Name"),
    )


EVENT_FACTS = """
event_facts as (
  select ts as "Datetime",
    case when event_id % 17 = 0 or event_id % 19 = 0 then null else round(value * 100) end
      as "Value",
    'run_' || (user_id % 2) as "__run_key",
    (user_id % 4)::double as "WS",
    event_type as "BZ",
    case when event_id % 3 <> 0 then 'generation' else 'load' end as "Property",
    case when event_id % 3 <> 0 then 'tech_' || (user_id % 5) end as "PEMMDB_TECHNOLOGY",
    case when event_id % 3 <> 0 then 'u' || user_id end as "Unit Name"
  from events)"""


def item_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: daily, area = return flag, unit = supplier."""
    dispatch = F.col("p_size") % 5 != 0
    items = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return items.select(
        F.col("l_shipdate").alias("Datetime"),
        F.round(F.col("l_extendedprice") * 100).alias("Value"),
        F.col("l_quantity").alias("Load"),
        F.col("l_linestatus").alias("__run_key"),
        F.col("l_linenumber").alias("WS"),
        F.col("l_returnflag").alias("BZ"),
        F.when(dispatch, "dispatch").otherwise("import").alias("Property"),
        F.when(dispatch, F.col("p_type")).alias("PEMMDB_TECHNOLOGY"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("Unit Name"),
        F.concat(F.lit("mc"), (F.col("l_orderkey") % 2).cast("string")).alias("Sample"),
    )


ITEM_FACTS = """
item_facts as (
  select l_shipdate as "Datetime",
    round(l_extendedprice * 100) as "Value",
    l_quantity as "Load",
    l_linestatus as "__run_key",
    l_linenumber as "WS",
    l_returnflag as "BZ",
    case when p_size % 5 <> 0 then 'dispatch' else 'import' end as "Property",
    case when p_size % 5 <> 0 then p_type end as "PEMMDB_TECHNOLOGY",
    's' || l_suppkey as "Unit Name",
    'mc' || (l_orderkey % 2) as "Sample"
  from lineitem join part on l_partkey = p_partkey)"""
