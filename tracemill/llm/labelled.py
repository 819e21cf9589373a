"""Labelled rows for training: split by id, bounded sample, features collected."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.stored import texts_of

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    features: Callable,
    schema: str,
    columns: list[Column],
    doc_id: str,
    most: int,
) -> pa.Table:
    """Features and ``label`` of at most ``most`` labelled rows that are not held out.

    The sample is the rows with the smallest hashes of their ids: the same on every
    run, and of all parts of the table. Its bound is what lets it go to the driver.
    ``features`` maps Arrow batches of ``columns``, and must hand on ``label``.
    """
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .where(~held_out(F.col("__id")))
        .dropDuplicates(["__id"])
    )
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    asked = texts_of(docs, F.col(doc_id).alias("__doc"), *columns)
    return (
        asked.join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
        .select("label", *asked.columns[1:])
        .mapInArrow(features, schema)
        .toArrow()
    )


def rows_of(table: pa.Table, name: str) -> list[np.ndarray]:
    """A list column as one array per row."""
    lists = table.column(name).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy()
    return np.split(flat, np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []


def first_of_each(*columns: list[np.ndarray]) -> list[int]:
    """Numbers of the rows that differ from all before them."""
    seen: dict[bytes, int] = {}
    for i, row in enumerate(zip(*columns)):
        key = hashlib.blake2b(digest_size=16)
        for own in row:
            key.update(len(own).to_bytes(8, "little") + own.tobytes())
        seen.setdefault(key.digest(), i)
    return list(seen.values())
