"""Series labels and technology clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.roles import col
from tracemill.session import rows_frame

# Texts in labels.
ALL_SERIES_LABEL = "Gesamt"
MISSING_LABEL = "NA"
COLUMN_LABELS = {"__source_file": "File", "__dispatch_component": "Dispatch"}

# The names under which a technology cluster appears in the data.
CLUSTERS = {
    "Battery": ["Battery", "Battery residential", "Battery utility scale"],
    "Biofuel": ["Biofuel"],
    "Biomass": ["Biomass"],
    "Coal": [
        "Coal",
        "Hard coal/New",
        "Hard coal/Old 1",
        "Hard coal/Old 2",
        "Lignite/New",
        "Lignite/Old 1",
        "Lignite/Old 2",
        "OtherNon-RES/Hard coal/Old 1",
        "OtherNon-RES/Lignite/Old 1",
    ],
    "Fuel_Cell": ["Fuel Cell"],
    "Gas": [
        "Gas",
        "Gas/CCGT new",
        "Gas/CCGT old 1",
        "Gas/CCGT old 2",
        "Gas/CCGT present 1",
        "Gas/CCGT present 2",
        "Gas/Conventional old 1",
        "Gas/Conventional old 2",
        "Gas/OCGT new",
        "Gas/OCGT old",
        "OtherNon-RES/Gas/CCGT CCS",
        "OtherNon-RES/Gas/CCGT old 1",
        "OtherNon-RES/Gas/CCGT old 2",
        "OtherNon-RES/Gas/CCGT present 2",
        "OtherNon-RES/Gas/Conventional old 1",
        "OtherNon-RES/Gas/Conventional old 2",
        "OtherNon-RES/Gas/OCGT old",
    ],
    "Nuclear": ["Nuclear"],
    "Oil": ["Oil", "Heavy oil/Old 1", "Heavy oil/Old 2", "Light oil", "Shale oil/New"],
    "Other": ["Other"],
    "Other_Non_RES": ["Other Non RES", "OtherNon-RES"],
    "Other_RES": ["Other RES", "other res 1"],
    "P2G": ["P2G"],
    "PSP": ["PSP", "Closed loop pumping", "Open loop pumping"],
    "PV": ["PV", "Solar pv", "Solar rooftop", "Solar thermal"],
    "RoR": ["RoR", "Run of river", "Reservoir", "Pondage"],
    "Storage": ["Storage"],
    "Wind": ["Wind", "Wind onshore", "Wind offshore"],
    "battery_load": ["battery load"],
    "hydrogen": ["hydrogen"],
    "implicit_dsr": ["implicit_dsr", "Demand shifting"],
    "pumpload_CL": ["pumpload_CL"],
    "pumpload_OL": ["pumpload_OL"],
}


def column_label(name: str) -> str:
    return COLUMN_LABELS.get(name, name)


def series_label(columns: Sequence[str]) -> Column:
    """``column=value`` for each column, joined by `` | ``; null reads ``NA``."""
    if not columns:
        return F.lit(ALL_SERIES_LABEL)
    parts = [
        F.concat(
            F.lit(f"{column_label(name)}="),
            F.coalesce(col(name).cast("string"), F.lit(MISSING_LABEL)),
        )
        for name in columns
    ]
    return F.concat_ws(" | ", *parts)


def normalized_technology(name: Column) -> Column:
    """Lower case, with ``_``, ``-``, ``/`` and runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_/-]+", " "))


def technology_clusters(df: DataFrame, technology: str, cluster: str = "cluster") -> DataFrame:
    """Add the cluster of each technology, null when the name is unknown.

    The lookup is the fixed list above (under 100 rows), so it is broadcast.
    """
    names = [(name, key) for key, aliases in CLUSTERS.items() for name in [key, *aliases]]
    lookup = (
        rows_frame(df.sparkSession, names, "name string, cluster string")
        .select(normalized_technology(F.col("name")).alias("__name"), F.col("cluster").alias(cluster))
        .distinct()
    )
    keyed = df.withColumn("__name", normalized_technology(col(technology)))
    return keyed.join(F.broadcast(lookup), "__name", "left").drop("__name")
