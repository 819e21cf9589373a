"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words; an item of fewer
words is one window. A window is the set of its shingles, and it is contained in a
document only if all of them are, so one shingle is a necessary prefix. Shingles
are ordered by how rare they are in the whole corpus, and the rarest of each
window is joined with the shingles of the documents. What meets is cut by bounds
of length and position, and the words are then compared one by one.

Two passes over the documents: the first counts the benchmark's shingles, the
second looks for the prefixes. Both ask a bit filter of bounded size first, so the
benchmark may grow too: the exact answer always comes from the join behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    ALNUM,
    find_words,
    giving_back,
    hash_windows,
    hash_words,
    list_array,
    text_blocks,
    window_starts,
)
from tracemill.llm.stored import BitFilter, RowNumbers, bit_filter, stored, texts_of

SHINGLE = 5
_WINDOWS = "item string, window string, size int, shingle int, hashes array<long>"
_ROWS = (
    "row long, n_words long, places array<long>, hashes array<long>, "
    "lefts array<int>, contexts array<string>"
)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """Hit words and items of every document.

    Returns one row per row of ``docs``: its id, ``n_words``, ``spans`` (runs of hit
    words: first word and length, in order), ``items`` (ids as texts, sorted) and
    ``contaminated``. Words are runs of ASCII letters and digits and of other
    characters outside ASCII; A-Z count as a-z. A null or empty text has no words.
    Items without words are in no document; items with the same id count once; a
    null item id is left out of ``items``, its hits count. Repeated documents are
    judged one by one. Other columns of ``docs`` are neither read nor returned.
    """
    windows = stored(
        items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
        .mapInArrow(lambda batches: _item_windows(batches, window), _WINDOWS)
        .distinct(),
        "windows",
    )
    sizes = sorted(r.shingle for r in windows.select("shingle").distinct().collect())
    source = texts_of(docs, F.col(doc_id).alias("id"), F.col(text).alias("text"))
    distinct = windows.dropDuplicates(["window"])
    tokens = stored(
        distinct.select(F.explode("hashes").alias("hash")).distinct(), "benchmark-shingles"
    )
    prefixes = _prefixes(source, distinct, tokens, sizes)
    wanted = prefixes.select("hash").distinct()
    found = bit_filter(wanted, wanted.count())
    kept = docs.schema[doc_id].dataType.simpleString()
    rows = stored(
        source.mapInArrow(
            lambda batches: _document_hits(batches, found, sizes, window), f"id {kept}, {_ROWS}"
        ),
        "hits",
    )
    occurrences = stored(_occurrences(rows, prefixes), "occurrences")
    owners = windows.select(F.md5("window").alias("window_id"), "item").dropna()
    named = (
        occurrences.select("row", "window_id")
        .distinct()
        .join(owners, "window_id")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return (
        rows.select("row", F.col("id").alias(doc_id), "n_words")
        .join(_spans(occurrences), "row", "left")
        .join(named, "row", "left")
        .select(
            doc_id,
            "n_words",
            F.coalesce("spans", F.array().cast("array<struct<start:long,length:long>>")).alias(
                "spans"
            ),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("spans").isNotNull().alias("contaminated"),
        )
    )


def _prefixes(
    source: DataFrame, windows: DataFrame, tokens: DataFrame, sizes: list[int]
) -> DataFrame:
    """The rarest shingle of every window, its place, and the window's words.

    Windows with a shingle that the corpus does not have are left out.
    """
    asked = bit_filter(tokens, tokens.count())
    counts = (
        source.select("text")
        .mapInArrow(lambda batches: _shingle_counts(batches, asked, sizes), "hash long, n long")
        .groupBy("hash")
        .agg(F.sum("n").alias("n"))
    )
    rarity = tokens.join(counts, "hash", "left").fillna(0, ["n"])
    placed = windows.select("window", "size", "shingle", F.posexplode("hashes")).withColumnsRenamed(
        {"pos": "place", "col": "hash"}
    )
    rarest = (
        placed.join(rarity, "hash")
        .groupBy("window")
        .agg(
            F.min(F.struct("n", "hash", "place", "size")).alias("least"),
        )
        .where("least.n > 0")
    )
    return stored(
        rarest.select(
            F.col("least.hash").alias("hash"),
            F.col("least.place").alias("place"),
            F.col("least.size").alias("size"),
            F.md5("window").alias("window_id"),
            F.split("window", " ").alias("words"),
        ),
        "prefixes",
    )


def _occurrences(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Places at which the whole window stands, word by word."""
    met = rows.where(F.size("places") > 0).select(
        "row",
        "n_words",
        F.inline(F.arrays_zip("places", "hashes", "lefts", "contexts")).alias(
            "at", "hash", "left", "context"
        ),
    )
    words = F.slice(F.split("context", " "), F.col("left") - F.col("place") + 1, F.col("size"))
    return (
        met.join(prefixes, "hash")
        .where("left >= place and at - place + size <= n_words")
        .where(words == F.col("words"))
        .select("row", (F.col("at") - F.col("place")).alias("start"), "size", "window_id")
        .distinct()
    )


def _spans(occurrences: DataFrame) -> DataFrame:
    """Runs of hit words by row: occurrences that touch are one run."""
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        occurrences.select("row", "start", (F.col("start") + F.col("size")).alias("end"))
        .distinct()
        .withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("opens").over(order))
        .groupBy("row", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    span = F.struct(
        F.col("start").cast("long").alias("start"),
        (F.col("end") - F.col("start")).cast("long").alias("length"),
    )
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


@giving_back
def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words = find_words(block, ALNUM)
            hashes = hash_words(block, words, lower=True)
            out: list[tuple] = []
            for row in range(block.high - block.low):
                first, last = int(words.first[row]), int(words.first[row + 1])
                size = min(window, last - first)
                if not size:
                    continue
                shingle = min(SHINGLE, size)
                grams = hash_windows(hashes[first:last], shingle).view(np.int64)
                texts = [
                    block.data[a:b].tobytes().lower().decode()
                    for a, b in zip(words.begin[first:last], words.end[first:last])
                ]
                item = batch.column("item")[block.low + row].as_py()
                for start in range(last - first - size + 1):
                    inner = grams[start : start + size - shingle + 1].tolist()
                    out.append((item, " ".join(texts[start : start + size]), size, shingle, inner))
            if out:
                columns = [list(column) for column in zip(*out)]
                yield pa.record_batch(
                    [
                        pa.array(columns[0], pa.string()),
                        pa.array(columns[1], pa.string()),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.list_(pa.int64())),
                    ],
                    ["item", "window", "size", "shingle", "hashes"],
                )


def _met(block, asked: BitFilter, sizes: list[int]):
    """Words of a block, and the places and hashes of shingles the filter lets through."""
    words = find_words(block, ALNUM)
    hashes = hash_words(block, words, lower=True)
    places, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for size in sizes:
        starts = window_starts(words, size)
        found = hash_windows(hashes, size)[starts] if len(starts) else np.empty(0, np.uint64)
        kept = asked.may_hold(found)
        places.append(starts[kept])
        grams.append(found[kept])
    return words, np.concatenate(places), np.concatenate(grams)


@giving_back
def _shingle_counts(
    batches: Iterator[pa.RecordBatch], asked: BitFilter, sizes: list[int]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            _, _, grams = _met(block, asked, sizes)
            values, counts = np.unique(grams, return_counts=True)
            yield pa.record_batch(
                [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"]
            )


@giving_back
def _document_hits(
    batches: Iterator[pa.RecordBatch], asked: BitFilter, sizes: list[int], window: int
) -> Iterator[pa.RecordBatch]:
    numbers = RowNumbers()
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, places, grams = _met(block, asked, sizes)
            order = np.argsort(places, kind="stable")
            places, grams = places[order], grams[order]
            rows = np.searchsorted(words.first, places, side="right") - 1
            inside = places - words.first[rows]
            lefts = np.minimum(inside, window)
            ends = np.minimum(places + window, words.first[rows + 1])
            contexts = [
                " ".join(
                    block.data[words.begin[w] : words.end[w]].tobytes().lower().decode()
                    for w in range(a, b)
                )
                for a, b in zip((places - lefts).tolist(), ends.tolist())
            ]
            counts = np.bincount(rows, minlength=block.high - block.low)
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, block.high - block.low),
                    pa.array(numbers.take(block.high - block.low)),
                    pa.array(words.counts),
                    list_array(inside, counts, pa.int64()),
                    list_array(grams.view(np.int64), counts, pa.int64()),
                    list_array(lefts.astype(np.int32), counts, pa.int32()),
                    list_array(contexts, counts, pa.string()),
                ],
                ["id", "row", "n_words", "places", "hashes", "lefts", "contexts"],
            )
