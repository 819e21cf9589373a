"""Refresh of the technology roll-up when files are added to the run folders.

The roll-up of each refresh is kept as its own part of a table. Sums of parts
are sums of all rows, so reading the table adds the parts up, and old files are
never read again. Files must be complete when they appear and not change later.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.clean import strip_names
from tracemill.operators.rollup import rollup_technology
from tracemill.roles import SUPPORTED_SUFFIXES, Roles, col
from tracemill.sources.runs import (
    any_case,
    data_folder,
    literal,
    qualified,
    run_key,
    shared_folder,
    source_path,
)

PART = "part"


def new_files(
    spark: SparkSession,
    root: str,
    schema: T.StructType | str,
    roles: Roles = Roles(),
    data_path: str | None = None,
    csv_options: dict[str, str] | None = None,
) -> DataFrame:
    """Stream of the rows of parquet and csv files of all runs, tagged like a load.

    With a data path only the files below it, of every run, come in. Files of hidden
    runs, and files outside of any run, are left out. Csv files have a header
    and their columns in the order of ``schema``; ``csv_options`` are those of
    Spark's reader, such as the layout of times.
    """
    shared = shared_folder(spark, root, data_path)
    inner = data_path and literal(data_path)
    pattern = literal(shared[0]) if shared else data_folder(literal(root), "*", inner)
    path = source_path(F.col("_metadata.file_path"))

    def rows(suffix: str) -> DataFrame:
        reader = spark.readStream.schema(schema).options(
            recursiveFileLookup="true", pathGlobFilter=any_case(suffix)
        )
        if suffix == ".csv":
            return reader.options(header="true", **(csv_options or {})).csv(pattern)
        return reader.parquet(pattern)

    tagged = [
        rows(suffix).withColumns(
            {roles.source: path, roles.run: run_key(path, qualified(spark, root), shared)}
        )
        for suffix in SUPPORTED_SUFFIXES
    ]
    return strip_names(reduce(DataFrame.unionByName, tagged)).where(
        ~col(roles.run).startswith(".")
    )


def refresh_rollup(
    rows: DataFrame,
    table: str,
    progress: str,
    time_columns: Sequence[str],
    roles: Roles = Roles(),
) -> None:
    """Roll up everything that is new since the last call, then return.

    ``progress`` is the folder in which Spark notes the files it has taken in.
    A refresh that fails half-way is done again with the same files and
    replaces its own part.
    """

    def add_part(batch: DataFrame, number: int) -> None:
        rolled = rollup_technology(batch, roles, time_columns)
        rolled.write.mode("overwrite").parquet(f"{table}/{PART}={number}")

    stream = rows.writeStream.foreachBatch(add_part).option("checkpointLocation", progress)
    stream.trigger(availableNow=True).start().awaitTermination()


def read_rollup(
    spark: SparkSession, table: str, time_columns: Sequence[str], roles: Roles = Roles()
) -> DataFrame:
    """The roll-up over all refreshes."""
    return rollup_technology(spark.read.parquet(table).drop(PART), roles, time_columns)
