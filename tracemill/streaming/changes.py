"""Refresh of the technology roll-up after files were added, rewritten or removed.

The roll-up is kept in parts. A part is the sums of some files, and a manifest says
which part holds which version of which file: its path, time of change and length. A
refresh compares the manifest with the files that are there. A file that is gone or was
rewritten takes its whole part away; what the part held of other files is read again,
with the files that are new, and becomes new parts. Sums of parts are sums of rows, so
everything else stays as it is.

Parts are written first and the new version of the manifest last. Until that is there,
readers see the old one, and a refresh that fails leaves parts that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.time import NTZ
from tracemill.functions.values import to_number
from tracemill.operators.clean import fact_table
from tracemill.operators.joins import lookup_join
from tracemill.operators.profile import numeric_columns
from tracemill.operators.rollup import rollup_technology
from tracemill.roles import Roles, col
from tracemill.session import durable, rows_frame
from tracemill.sources.runs import child_names, discover_files
from tracemill.sources.tables import load_chosen

# About so many bytes of files become one part.
PART_BYTES = 1 << 30
# A path and its part, in the join that gives rows their part.
_ROW_BYTES = 512

PART = "__part"
MANIFEST = f"path string, length bigint, modified {NTZ}, {PART} string"


@dataclass(frozen=True)
class Changes:
    """What a refresh found: files by what became of them, and files read again."""

    added: int
    rewritten: int
    removed: int
    reread: int


def refresh_changed(
    spark: SparkSession,
    root: str,
    table: str,
    time_columns: Sequence[str] | None = None,
    roles: Roles = Roles(),
    data_path: str | None = None,
    part_bytes: int = PART_BYTES,
) -> Changes:
    """Bring the roll-up below ``table`` in line with the files below ``root``.

    ``time_columns`` are those that sums are kept apart by, the role's own by default.
    Texts and scenarios are kept in one type whatever the files have, so that parts of
    different times fit each other.
    """
    times = list(time_columns or [roles.time])
    files = durable(discover_files(spark, root, None, data_path))
    version, known = _manifest(spark, table)
    now = files.select("path", "suffix", "length", "modified")
    old = known.select(
        "path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), PART
    )
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    state = (
        F.when(F.col("old_length").isNull(), "added")
        .when(F.col("length").isNull(), "removed")
        .when(same, "same")
        .otherwise("rewritten")
    )
    compared = durable(now.join(old, "path", "full").withColumn("state", state))
    counts = {row["state"]: row["count"] for row in compared.groupBy("state").count().collect()}
    spoilt = compared.where(F.col("state").isin("removed", "rewritten")).select(PART).distinct()
    kept = compared.where("state = 'same'").join(spoilt, PART, "left_anti")
    again = compared.where("state = 'same'").join(spoilt, PART, "left_semi")
    asked = compared.where(F.col("state").isin("added", "rewritten")).unionByName(again.select(compared.columns))
    asked = durable(asked.select("path", "suffix", "length", "modified"))
    total = asked.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    changes = Changes(
        counts.get("added", 0), counts.get("rewritten", 0), counts.get("removed", 0), 0
    )
    if not total["n"] and not changes.removed:
        return changes
    parts = 1 + (total["bytes"] or 0) // part_bytes
    token = uuid.uuid4().hex
    number = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("string")
    dealt = durable(asked.withColumn(PART, F.concat(F.lit(f"{token}-"), number)))
    if total["n"]:
        rows = _uniform(fact_table(load_chosen(spark, root, files, dealt, data_path, roles), roles), times, roles)
        # Listings and rows write a local file's scheme in different ways.
        plain = [F.regexp_replace(name, "^file:/+", "file:/") for name in ("path", roles.source)]
        lookup = dealt.select(plain[0].alias("__file"), PART)
        rows = rows.withColumn("__file", plain[1])
        tagged = lookup_join(rows, lookup, ["__file"], times, _ROW_BYTES).drop("__file")
        rolled = rollup_technology(tagged, roles, [*times, PART])
        # Files without rows, too, belong to a part: it may have no folder.
        rolled.write.mode("append").partitionBy(PART).parquet(f"{table.rstrip('/')}/parts")
    columns = ["path", "length", "modified", PART]
    fresh = kept.select(columns).unionByName(dealt.select(columns))
    fresh.write.parquet(_version_path(table, version + 1))
    reread = total["n"] - changes.added - changes.rewritten
    return Changes(changes.added, changes.rewritten, changes.removed, reread)


def read_changed(
    spark: SparkSession, table: str, time_columns: Sequence[str] | None = None, roles: Roles = Roles()
) -> DataFrame:
    """The roll-up over all files that the last refresh found."""
    _, known = _manifest(spark, table)
    if not any("=" in name for name in child_names(spark, f"{table.rstrip('/')}/parts")):
        raise ValueError("no refresh has found any row")
    parts = spark.read.option("mergeSchema", "true").parquet(f"{table.rstrip('/')}/parts")
    named = known.select(F.col(PART).alias("__named")).distinct()
    held = parts.join(named, F.col(PART) == F.col("__named"), "left_semi").drop(PART)
    return rollup_technology(held, roles, list(time_columns or [roles.time]))


def _uniform(rows: DataFrame, times: Sequence[str], roles: Roles) -> DataFrame:
    """Dimensions in one type: scenarios as numbers, the others as texts; sums as doubles."""
    texts = {roles.run, roles.technology, roles.prop, roles.area, roles.sample, roles.source}
    numbers = set(numeric_columns(rows)) - {*texts, *times, roles.unit}
    changed = {}
    for field in rows.schema.fields:
        if field.name in texts:
            changed[field.name] = col(field.name).cast("string")
        elif field.name == roles.ws:
            changed[field.name] = to_number(col(field.name), field.dataType)
        elif field.name in times:
            kept = isinstance(field.dataType, (T.TimestampNTZType, T.StringType))
            changed[field.name] = col(field.name) if kept else col(field.name).cast("string")
        elif field.name in numbers:
            changed[field.name] = col(field.name).cast("double")
    return rows.select(*[value.alias(name) for name, value in changed.items()])


def _version_path(table: str, version: int) -> str:
    return f"{table.rstrip('/')}/manifest/version={version}"


def _manifest(spark: SparkSession, table: str) -> tuple[int, DataFrame]:
    """The highest number of a version, and the last version that is whole; before it, none."""
    names = child_names(spark, f"{table.rstrip('/')}/manifest")
    versions = sorted((int(name.split("=")[1]) for name in names if "=" in name), reverse=True)
    for version in versions:
        path = _version_path(table, version)
        if "_SUCCESS" in child_names(spark, path):  # written to its end
            return versions[0], spark.read.schema(MANIFEST).parquet(path)
    return max(versions, default=0), rows_frame(spark, [], MANIFEST)
