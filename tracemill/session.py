"""Session defaults and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"

ARROW_TYPES = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators are written for: naive UTC times and AQE."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Files of a checkpoint go when nothing refers to it any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the call site of every column makes plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by the session.

    The folder is that of ``spark.checkpoint.dir``. Only a session whose executors
    are threads of the driver may do without: it gets a temporary folder. On a
    cluster, also one of processes on this machine, there is none to fall back on.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tracemill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written.

    Starts a job. Used where later steps must all see the same rows in the same
    partitions, also after an executor is lost.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A short list of rows of texts, numbers and truth values as a frame.

    Made from an Arrow table, the rows become part of the plan: no Python
    worker reads them, and Spark knows their number and size.
    """
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    table = pa.table(
        {
            field.name: pa.array(column, ARROW_TYPES[field.dataType.simpleString()])
            for field, column in zip(fields, columns)
        }
    )
    return spark.createDataFrame(table, schema=fields)
