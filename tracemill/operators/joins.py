"""Joins of many rows with a lookup of few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup whose counted rows stay within this many bytes is broadcast.
BROADCAST_BYTES = 16 << 20
_COPY = "__copy"


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    """Inner join on ``keys`` that does not gather the rows of a key in one task.

    The rows of each key are split by a hash of the ``spread`` columns, and the
    lookup is copied once per part: as many parts as there are shuffle partitions.
    When the lookup turns out to be small, Spark broadcasts it at run time instead.
    """
    setting = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    copies = max(1, int(setting)) if setting.isdigit() else rows.sparkSession.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64(*spread), F.lit(copies)).cast("int")
    copied = lookup.withColumn(_COPY, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn(_COPY, part).join(copied, [*keys, _COPY]).drop(_COPY)


def may_broadcast(rows: int, row_bytes: int) -> bool:
    """Whether so many rows of at most so many bytes stay within the bound."""
    return rows * row_bytes <= BROADCAST_BYTES


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str], row_bytes: int
) -> DataFrame:
    """Inner join with a stored lookup: broadcast if its size allows, else spread.

    Starts a job that counts the lookup; its rows take ``row_bytes`` at most.
    """
    if may_broadcast(lookup.count(), row_bytes):
        return rows.join(F.broadcast(lookup), [*keys])
    return spread_join(rows, lookup, keys, spread)
