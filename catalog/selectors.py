"""Selector index, hierarchy and option lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.facts import event_facts, item_facts, table
from catalog.traces import with_facts
from tracemill.operators.selector import (
    leaf_properties,
    leaf_technologies,
    membership_filter,
    options_by_label,
    options_by_value,
    property_choices,
    selector_index,
    selector_tree,
    tree_leaf,
    unit_options,
)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return selector_index(event_facts(spark, folder))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return selector_tree(selector_index(blanked(spark, folder)))


def blanked(spark: SparkSession, folder: str) -> DataFrame:
    """Events with blank and missing names, as found in files."""
    facts = event_facts(spark, folder)
    blank = F.col("WS") == 3
    return facts.withColumns(
        {
            "PEMMDB_TECHNOLOGY": F.when(
                blank & (F.col("BZ") == "view"), F.lit(" \t\n")
            ).otherwise(F.col("PEMMDB_TECHNOLOGY")),
            "Property": F.when(blank & (F.col("BZ") == "click"), F.lit(None)).otherwise(
                F.col("Property")
            ),
            "WS": F.when(F.col("WS") == 2, F.lit(float("nan"))).otherwise(F.col("WS")),
        }
    )


BLANKED = """blanked as (select "__run_key" as run, "WS" as ws, "BZ" as area,
  case when "WS" = 3 and "BZ" = 'click' then null else "Property" end as property,
  case when "WS" = 3 and "BZ" = 'view' then '  ' else "PEMMDB_TECHNOLOGY" end as technology
  from event_facts where "WS" <> 2)
"""


def leaf(spark: SparkSession, folder: str) -> DataFrame:
    return tree_leaf(selector_tree(selector_index(event_facts(spark, folder))), "run_0", "0", "click")


def needs_technology(spark: SparkSession, folder: str) -> DataFrame:
    return leaf_properties(leaf(spark, folder))


def technologies(spark: SparkSession, folder: str) -> DataFrame:
    return leaf_technologies(leaf(spark, folder), "generation")


def units(spark: SparkSession, folder: str) -> DataFrame:
    known = selector_index(event_facts(spark, folder))
    return unit_options(known, "run_0", "0.0", "click", "generation", "tech_1")


def units_loose(spark: SparkSession, folder: str) -> DataFrame:
    known = selector_index(event_facts(spark, folder))
    return unit_options(known, None, None, "view", "generation", None)


def by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Order keys as texts: 10 comes before 2."""
    return options_by_label(table(spark, folder, "orders"), "o_orderkey")


def by_value(spark: SparkSession, folder: str) -> DataFrame:
    return options_by_value(table(spark, folder, "orders"), "o_orderkey")


def properties(spark: SparkSession, folder: str) -> DataFrame:
    """Every property of any leaf, alone or with a technology."""
    return property_choices(selector_tree(selector_index(event_facts(spark, folder))))


def members(spark: SparkSession, folder: str) -> DataFrame:
    facts = item_facts(spark, folder)
    kept = membership_filter(facts, "PEMMDB_TECHNOLOGY", ["PROMO", "SMALL"])
    kept = membership_filter(membership_filter(kept, "WS", [1, 2, 5]), "absent", [1])
    return membership_filter(kept, "BZ", []).select(
        "Datetime", "Value", "WS", "PEMMDB_TECHNOLOGY", "Unit Name"
    )


_CLICK = "\"__run_key\" = 'run_0' and \"WS\" = 0 and \"BZ\" = 'click'"


def options_sql(body: str) -> str:
    return f"""found as ({body}),
ranked as (select row_number() over (order by label) as rank, value, label from found)
select * from ranked"""


def first_labels(spark: SparkSession, folder: str) -> DataFrame:
    return options_by_label(table(spark, folder, "orders"), "o_orderkey", 500)


QUERIES = {
    "selector_index": index,
    "selector_hierarchy": hierarchy,
    "selector_leaf": leaf,
    "property_requires_technology": needs_technology,
    "technology_options": technologies,
    "unit_options": units,
    "unit_options_loose": units_loose,
    "value_options_label": by_label,
    "value_options_native": by_value,
    "value_options_first": first_labels,
    "property_union": properties,
    "membership_filter": members,
}
ORACLES = {
    "selector_index": with_facts(
        "event_facts",
        """found as (select distinct "__run_key", "BZ", "WS", "Property", "PEMMDB_TECHNOLOGY",
  "Unit Name" from event_facts)
select * from found""",
    ),
    "selector_hierarchy": with_facts(
        "event_facts",
        BLANKED
        + """select distinct run, ws, area, property,
  case when property is not null and trim(technology) <> '' then technology end as technology
from blanked""",
    ),
    "selector_leaf": with_facts(
        "event_facts",
        f"""found as (select distinct "Property" as property, "PEMMDB_TECHNOLOGY" as technology
  from event_facts where {_CLICK})
select * from found""",
    ),
    "property_requires_technology": with_facts(
        "event_facts",
        f"""found as (select "Property" as property,
  count("PEMMDB_TECHNOLOGY") > 0 as requires_technology from event_facts where {_CLICK} group by 1)
select * from found""",
    ),
    "technology_options": with_facts(
        "event_facts",
        f"""found as (select distinct "PEMMDB_TECHNOLOGY" as technology from event_facts
  where {_CLICK} and "Property" = 'generation' and "PEMMDB_TECHNOLOGY" is not null)
select * from found""",
    ),
    "unit_options": with_facts(
        "event_facts",
        options_sql(
            f"""select distinct "Unit Name" as value, "Unit Name" as label from event_facts
  where {_CLICK} and "Property" = 'generation' and "PEMMDB_TECHNOLOGY" = 'tech_1'"""
        ),
    ),
    "unit_options_loose": with_facts(
        "event_facts",
        options_sql(
            """select distinct "Unit Name" as value, "Unit Name" as label from event_facts
  where "BZ" = 'view' and "Property" = 'generation' and "Unit Name" is not null"""
        ),
    ),
    "value_options_label": "with "
    + options_sql("select distinct o_orderkey as value, o_orderkey::varchar as label from orders"),
    "value_options_first": "with "
    + options_sql("select distinct o_orderkey as value, o_orderkey::varchar as label from orders")
    + " where rank <= 500",
    "value_options_native": "with "
    + options_sql(
        "select distinct o_orderkey as value, o_orderkey::varchar as label from orders"
    ).replace("order by label", "order by value"),
    "property_union": with_facts(
        "event_facts",
        'found as (select distinct "Property" as property from event_facts)\nselect * from found',
    ),
    "membership_filter": with_facts(
        "item_facts",
        """kept as (select "Datetime", "Value", "WS", "PEMMDB_TECHNOLOGY", "Unit Name" from item_facts
  where "PEMMDB_TECHNOLOGY" in ('PROMO', 'SMALL') and "WS" in (1, 2, 5))
select * from kept""",
    ),
}
