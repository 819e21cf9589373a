"""Reversible line dedup: exact reference counts, and sharded cuckoo filters before them.

Two tables are exact. ``holders`` has a row for every line key and document that
holds it, ``counts`` has for every key the number of its documents and the largest
id among them. Keys found in at least ``min_docs`` documents are also in the cuckoo
filter of their shard, so most lines are known to stay without a look at the
tables; a line that a filter lets through is joined with ``counts``, and that alone
decides. Documents can be added and taken away again: the counts move by their
keys, and keys that cross the limit enter or leave the filters.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.stored import stored

if TYPE_CHECKING:  # not in workers that need no pandas
    import pandas as pd

# What is stripped from a line and how its case is folded.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A shard's filter is made for about this many keys, and at most this many lines
# are held against one copy of it in one task.
SHARD_KEYS = 200_000
PROBES = 100_000
_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """A set of 64-bit keys in buckets of four 16-bit marks; may hold, never loses."""

    def __init__(self, keys: int, cells: np.ndarray | None = None) -> None:
        buckets = 1 << max(4, (int(keys / (_SLOTS * 0.84)) or 1).bit_length())
        self.cells = np.zeros((buckets, _SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls(size)
            if made.insert(keys):
                return made
            size = 2 * size + 16

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.uint64(len(self.cells) - 1)
        mark = (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        first = (keys & last).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        step = mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(32)
        return bucket ^ (step & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys, each as often as it is given; False if there was no room for all."""
        mark, first, second = self._where(keys)
        random = np.random.default_rng(len(keys))
        bucket = first
        for turn in range(_KICKS):
            if not len(mark):
                return True
            # One newcomer a bucket and turn; the others wait for the next turn.
            _, chosen = np.unique(bucket, return_index=True)
            places = bucket[chosen]
            free = self.cells[places] == 0
            room = free.any(axis=1)
            slot = np.where(room, free.argmax(axis=1), random.integers(0, _SLOTS, len(places)))
            full = ~room
            out = np.where(full, self.cells[places, slot], 0).astype(np.uint16)
            if turn == 0:  # try the other bucket before anything is moved
                self.cells[places[room], slot[room]] = mark[chosen[room]]
                rest = np.ones(len(mark), bool)
                rest[chosen[room]] = False
                bucket, mark = np.where(rest, second, bucket)[rest], mark[rest]
                continue
            self.cells[places, slot] = mark[chosen]
            rest = np.ones(len(mark), bool)
            rest[chosen] = False
            moved = self._other(places[full], out[full])
            bucket = np.concatenate([bucket[rest], moved])
            mark = np.concatenate([mark[rest], out[full]])
        return not len(mark)

    def remove(self, keys: np.ndarray) -> None:
        """Take away keys that were inserted."""
        for mark, *buckets in zip(*self._where(keys)):
            for bucket in buckets:
                slots = np.flatnonzero(self.cells[bucket] == mark)
                if len(slots):
                    self.cells[bucket, slots[0]] = 0
                    break

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._where(keys)
        own = mark[:, None]
        return (self.cells[first] == own).any(axis=1) | (self.cells[second] == own).any(axis=1)


@dataclass
class LineIndex:
    """Exact tables and filters over the lines of some documents."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with more documents; their ids must be new to it."""
        more = stored(_held(docs, doc_id, text, self.min_chars), "holders")
        counts = self.counts.unionByName(_counted(more))
        return self._moved(self.holders.unionByName(more), _summed(counts))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents in ``ids``, as if they had never come."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("gone")).distinct()
        lost = self.holders.join(gone, self.holders.doc.eqNullSafe(gone.gone)).drop("gone")
        left = self.holders.join(gone, self.holders.doc.eqNullSafe(gone.gone), "left_anti")
        touched = lost.select("key").distinct()
        again = _counted(left.join(touched, "key", "left_semi"))
        rest = self.counts.join(touched, "key", "left_anti")
        return self._moved(left, rest.unionByName(again))

    def _moved(self, holders: DataFrame, counts: DataFrame) -> LineIndex:
        """New tables, with keys that crossed the limit put in or out of the filters."""
        holders, counts = stored(holders, "holders"), stored(counts, "counts")
        was = self.counts.where(F.col("docs") >= self.min_docs).select("key")
        now = counts.where(F.col("docs") >= self.min_docs).select("key")
        changes = (
            now.join(was, "key", "left_anti")
            .withColumn("enters", F.lit(True))
            .unionByName(was.join(now, "key", "left_anti").withColumn("enters", F.lit(False)))
            .select(_shard(self.shards), _hash().alias("hash"), "enters")
        )

        def change(shard: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            import pandas as pd

            hashes = keys["hash"].to_numpy(np.int64).view(np.uint64)
            enters = keys["enters"].to_numpy(bool)
            made = _unpacked(old["cells"].iloc[0]) if len(old) else CuckooFilter.of(hashes[enters])
            if len(old):
                made.remove(hashes[~enters])
                if not made.insert(hashes[enters]):
                    return pd.DataFrame({"shard": [shard[0]], "cells": [None]})
            return pd.DataFrame({"shard": [shard[0]], "cells": [made.cells.tobytes()]})

        filters = stored(
            self.filters.groupBy("shard")
            .cogroup(changes.groupBy("shard"))
            .applyInPandas(change, "shard int, cells binary"),
            "filters",
        )
        # A filter without room for its newcomers is made anew from the exact table.
        full = filters.where("cells is null").select("shard")
        if not full.isEmpty():
            anew = _made(now.select(_shard(self.shards), _hash().alias("hash")).join(full, "shard"))
            filters = stored(filters.where("cells is not null").unionByName(anew), "filters")
        return LineIndex(holders, counts, filters, self.shards, self.min_docs, self.min_chars)

    def repeated(
        self, docs: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text"
    ) -> DataFrame:
        """Keys that each document loses: ``doc``, ``keys``. Only documents that lose some.

        Without ``docs``, the documents of the index.
        """
        held = self.holders
        if docs is not None:
            held = stored(_held(docs, doc_id, text, self.min_chars), "lines")
        lines = held.select("key", "doc", _hash().alias("hash"), _shard(self.shards))
        most = lines.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        copies = 1 + most // PROBES

        def probe(part: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(found):
                return own.iloc[:0][["key", "doc"]]
            hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
            return own.loc[_unpacked(found["cells"].iloc[0]).may_hold(hashes), ["key", "doc"]]

        dealt = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
        through = (
            lines.withColumn("copy", F.pmod(F.xxhash64("doc"), F.lit(copies)).cast("int"))
            .groupBy("shard", "copy")
            .cogroup(self.filters.select("*", dealt).groupBy("shard", "copy"))
            .applyInPandas(probe, "key binary, doc long")
        )
        over = self.counts.where(F.col("docs") >= self.min_docs)
        keeps = F.col("doc").eqNullSafe(F.col("keeper"))
        return (
            through.join(over, "key")
            .where(~keeps)
            .groupBy("doc")
            .agg(F.collect_list("key").alias("keys"))
        )


def line_index(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 5,
    min_chars: int = 40,
) -> LineIndex:
    """An index over the lines of ``docs``."""
    holders = stored(_held(docs, doc_id, text, min_chars), "holders")
    counts = stored(_counted(holders), "counts")
    over = counts.where(F.col("docs") >= min_docs)
    shards = 1 + over.count() // SHARD_KEYS
    filters = stored(_made(over.select(_shard(shards), _hash().alias("hash"))), "filters")
    return LineIndex(holders, counts, filters, shards, min_docs, min_chars)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 5,
    min_chars: int = 40,
    index: LineIndex | None = None,
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two more columns.

    A line's key is the line without ASCII white space at its ends and with A-Z as
    a-z. A key of at least ``min_chars`` code points that is in at least ``min_docs``
    documents stays only in the document with the largest id. ``n_lines`` counts
    lines before, ``n_dropped`` those taken out. With an ``index``, its documents are
    counted instead of those of ``docs``, and its limits hold. The text is null where it was, else
    the other lines in order. Rows with the same id count as documents one by one
    and lose the same lines; null is the smallest id. All other columns are kept;
    ``n_lines`` and ``n_dropped`` are overwritten. Ids are whole numbers.
    """
    if index is None:
        index = line_index(docs, doc_id, text, min_docs, min_chars)
        lost = index.repeated()
    else:
        lost = index.repeated(docs, doc_id, text)
    lost = lost.select(F.struct("doc", "keys").alias("__lost"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__own"))
    on = F.col(f"__own.`{doc_id}`").cast("long").eqNullSafe(F.col("__lost.doc"))
    lines = F.split(F.coalesce(F.col(f"__own.`{text}`"), F.lit("")), "\n", -1)
    keys = F.col("__lost.keys")
    kept = F.when(keys.isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda line: ~_in(keys, _key(line), min_chars))
    )
    joined = own.join(lost, on, "left").withColumn("__lines", lines).withColumn("__kept", kept)
    texts = F.when(F.col(f"__own.`{text}`").isNotNull(), F.array_join("__kept", "\n"))
    return joined.select(
        *(
            texts.alias(c) if c == text else F.col(f"__own.`{c}`").alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
    )


def _in(keys: Column, line: Column, min_chars: int) -> Column:
    return (F.char_length(line) >= min_chars) & F.array_contains(keys, _digest(line))


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _hash() -> Column:
    """64 bits of a key's digest."""
    return F.conv(F.substring(F.hex("key"), 1, 16), 16, -10).cast("long")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _held(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``key`` and ``doc``: the long lines of every row, each once."""
    keys = F.transform(F.split(F.col(text), "\n", -1), _key)
    long = F.array_distinct(F.filter(keys, lambda key: F.char_length(key) >= min_chars))
    return docs.select(
        F.explode(F.transform(long, _digest)).alias("key"), F.col(doc_id).cast("long").alias("doc")
    )


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


def _made(keys: DataFrame) -> DataFrame:
    def make(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        made = CuckooFilter.of(rows["hash"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [shard[0]], "cells": [made.cells.tobytes()]})

    return keys.groupBy("shard").applyInPandas(make, "shard int, cells binary")


def _unpacked(cells: bytes) -> CuckooFilter:
    return CuckooFilter(0, np.frombuffer(bytearray(cells), np.uint16).reshape(-1, _SLOTS))
