"""Written intermediate tables, row numbers, bit filters and bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import scratch_path

if TYPE_CHECKING:  # not in workers that need no pandas
    import pandas as pd

# A joined side of more bytes than this is shuffled, not broadcast. It bounds
# what every executor holds; both ways give the same rows.
BROADCAST_BYTES = 16 << 20

# A bit filter has 2**FILTER_BITS bits at most (16 MB), however many hashes it
# holds: a fuller filter lets more rows through to the exact join behind it.
# A small filter is not made smaller than 1 MB, so that hardly any of a corpus's many
# other hashes gets through.
FILTER_BITS, LEAST_FILTER_BITS = 27, 23
_SEGMENT_BITS = 16

BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(docs: DataFrame, *columns: Column) -> DataFrame:
    """Columns of documents, to be read by tasks in Python.

    Arrow batches are cut by rows alone, and rows of text are long. So the session's
    batches are made smaller, if they are larger: they bound what a task holds.
    """
    conf = docs.sparkSession.conf
    rows = int(conf.get(_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return docs.select(*columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the session's shared folder and read it again.

    Later steps all see the same rows, also after an executor is lost, and the
    work before is done once. The files stay until the folder is emptied.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class RowNumbers:
    """Numbers for the rows of a task: unique over all tasks, fixed once stored."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self._next = (context.partitionId() if context else 0) << 40

    def take(self, count: int) -> np.ndarray:
        self._next += count
        return np.arange(self._next - count, self._next, dtype=np.int64)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys in which null equals null."""
    return reduce(lambda a, b: a & b, (left[key].eqNullSafe(right[key]) for key in keys))


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


class BitFilter:
    """Tells in a task that a hash is not in a set, or may be in it."""

    def __init__(self, bits: int, cells: Broadcast) -> None:
        self._bits, self._cells = bits, cells

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> np.uint64(64 - self._bits)
        cells = np.frombuffer(self._cells.value, np.uint8)
        return (cells[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_filter(hashes: DataFrame, count: int, bits_each: int = 64) -> BitFilter:
    """A filter over the longs in column ``hash``, of which there are ``count``.

    Segments of the filter are made in tasks; the driver puts them side by side,
    at most 16 MB.
    """
    bits = min(FILTER_BITS, max(LEAST_FILTER_BITS, (max(1, count) * bits_each - 1).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - bits)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        cells = np.zeros(1 << _SEGMENT_BITS, bool)
        cells[rows["place"].to_numpy()] = True
        packed = np.packbits(cells, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [key[0]], "cells": [packed]})

    segments = (
        hashes.select(
            F.shiftright(slot, _SEGMENT_BITS).cast("int").alias("segment"),
            slot.bitwiseAND((1 << _SEGMENT_BITS) - 1).cast("int").alias("place"),
        )
        .distinct()
        .groupBy("segment")
        .applyInPandas(fill, "segment int, cells binary")
    )
    size = 1 << (_SEGMENT_BITS - 3)
    cells = bytearray(size << (bits - _SEGMENT_BITS))
    for segment, packed in segments.collect():
        cells[segment * size : (segment + 1) * size] = packed
    return BitFilter(bits, hashes.sparkSession.sparkContext.broadcast(bytes(cells)))
