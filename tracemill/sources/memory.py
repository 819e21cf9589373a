"""Shapes of time texts, remembered for every version of a file.

To find the layout of a time column all its texts have to be looked at. What is found is a
histogram of shapes, and the histogram of some files is the sum of theirs. So it is kept
file by file, under the file's path, length and time of change: a load looks at new and
changed files only, and takes the rest from what is remembered. Entries of files that are
gone or have changed do not match any file and are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.time import NTZ
from tracemill.operators.clean import Reading, readings_of
from tracemill.operators.shapes import ORDERS, Shapes, shape_counts
from tracemill.roles import Roles, col
from tracemill.session import durable, rows_frame
from tracemill.sources.quoted import plain_path
from tracemill.sources.runs import child_names, discover_files
from tracemill.sources.tables import load_chosen

_COUNTS = ("n", *(f"{kind}_{order}" for order in ORDERS for kind in ("may", "sure")))
_VERSION = ("path", "length", "modified")
_SCHEMA = f"path string, length bigint, modified {NTZ}, column string, shape string, " + ", ".join(
    f"{name} bigint" for name in _COUNTS
)


def remembered_readings(
    spark: SparkSession,
    root: str,
    loaded: DataFrame,
    column: str,
    memory: str,
    runs: list[str] | None = None,
    data_path: str | None = None,
    roles: Roles = Roles(),
) -> dict[str, Reading] | None:
    """The layout of a time column for each run, as ``time_readings`` finds it.

    ``loaded`` is what ``load_runs`` gives for the same runs; ``memory`` is a folder for
    what is remembered, of any number of roots and columns. ``None`` if the column holds
    no texts. Files that are not remembered are read, this column only, and remembered.
    """
    if column not in loaded.columns or not isinstance(loaded.schema[column].dataType, T.StringType):
        return None
    files = discover_files(spark, root, runs, data_path).select("run", "suffix", *_VERSION)
    known = durable(files.join(_entries(spark, memory, column), list(_VERSION), "left"))
    fresh = known.where("column is null")
    if not fresh.isEmpty():
        files = known.select(*files.columns).distinct()
        _remember(spark, root, files, fresh, column, memory, data_path, roles)
        known = files.join(_entries(spark, memory, column), list(_VERSION))
    summed = known.groupBy("run", "shape").agg(*[F.sum(name).alias(name) for name in _COUNTS])
    found: dict[str, Shapes] = {}
    # As many rows as runs have shapes: some tens each.
    for row in summed.where("n > 0").collect():
        found.setdefault(row["run"], Shapes()).rows.append(row.asDict())
    texts = loaded.select(
        F.coalesce(col(roles.run).cast("string"), F.lit("")).alias("group"), col(column).alias("text")
    )
    return readings_of(texts, found, column)


def _place(memory: str) -> str:
    return f"{memory.rstrip('/')}/shapes"


def _entries(spark: SparkSession, memory: str, column: str) -> DataFrame:
    if not child_names(spark, _place(memory)):
        return rows_frame(spark, [], _SCHEMA)
    entries = spark.read.schema(_SCHEMA).parquet(_place(memory)).where(F.col("column") == column)
    # Two loads at the same time may both have remembered a file.
    return entries.dropDuplicates([*_VERSION, "shape"])


def _remember(
    spark: SparkSession,
    root: str,
    files: DataFrame,
    fresh: DataFrame,
    column: str,
    memory: str,
    data_path: str | None,
    roles: Roles,
) -> None:
    rows = load_chosen(spark, root, files, fresh, data_path, roles)
    marks = fresh.select(*_VERSION, F.lit(column).alias("column"), F.lit(None).cast("string").alias("shape"))
    # A file without rows, or without the column, is remembered as that.
    marks = marks.withColumns({name: F.lit(0).cast("long") for name in _COUNTS})
    if column in rows.columns:
        texts = rows.select(
            plain_path(col(roles.source)).alias("group"), col(column).cast("string").alias("text")
        )
        counts = shape_counts(texts).withColumnRenamed("group", "__path")
        versions = fresh.select(*_VERSION).withColumn("__path", plain_path(F.col("path")))
        seen = counts.join(versions, "__path").withColumn("column", F.lit(column))
        marks = marks.unionByName(seen.select(marks.columns))
    marks.write.mode("append").parquet(_place(memory))
