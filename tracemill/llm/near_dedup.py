"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

Documents of the same words are one class, and one of them stands for it. Its
MinHash samples are cut into bands; documents that share a band are candidates,
and candidates hang together in clusters. A document's samples are also folded
into an odd sketch: a bitmap in which every sample toggles one bit. The number of
ones in the XOR of two sketches estimates how many samples differ, which is most
precise where similarities are high. Pairs of a cluster that the sketches do not
rule out are confirmed on the full shingle sets; two documents already known to be
connected are not compared again, and no pair leaves its task.

With 32 bands of 6 samples a pair of similarity 0.85 shares no band with a
probability of 3e-7; the sketches rule out pairs estimated more than five
standard deviations below the limit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    Block,
    find_words,
    give_back,
    giving_back,
    hash_windows,
    hash_words,
    list_array,
    mixed,
    ragged,
    text_blocks,
)
from tracemill.llm.components import components
from tracemill.llm.stored import RowNumbers, bounded, stored, texts_of

BANDS, BAND_ROWS = 32, 6
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 512
# Samples and bitmap together estimate a similarity near the limit to about 0.028.
SKETCH_MARGIN = 0.14

# One task compares clusters, or two blocks of one cluster, of about this many
# shingles; a block has them all in memory.
TASK_SHINGLES = 2_000_000

_random = np.random.default_rng(715)
_SEEDS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FACTORS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_FOLDS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)

_SIGNATURE = "row long, class binary, n_shingles long, bands array<long>, sketch binary"
_SETS = "node long, cluster long, sketch binary, shingles array<long>"


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: int = 85,
    words: int = 5,
) -> DataFrame:
    """Components of documents linked by near-equal sets of shingles.

    Returns one row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and
    ``kept``. A set has the distinct runs of ``words`` words of the text with A-Z as
    a-z; of fewer words it has one, the whole text. Two documents are linked if
    100 times the shared shingles is at least ``similarity`` times all of both;
    ``similarity`` is 80 or more. Null, empty and blank texts have no set and no
    link. ``component_id`` is the smallest id that links reach, and ``kept`` says that
    the row has it. Rows with the same id get the same answer if their texts agree.
    Rows without an id link like others; their component is named by ids only, and
    they are kept only if there is none. Other columns are not used.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = texts_of(docs, F.col(doc_id).alias("id"), F.col(text).alias("text"))
    signed = stored(
        source.mapInArrow(lambda batches: _signatures(batches, words), f"id {kind}, {_SIGNATURE}"),
        "signatures",
    )
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("class")
        .agg(F.min("row").alias("node"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("class", "node")
    )
    members = stored(
        signed.select("row", "id", "class", "n_shingles")
        .join(bounded(stored(classes, "classes"), 64), "class", "left")
        .withColumn("node", F.coalesce("node", "row")),
        "members",
    )
    links = _links(source, signed, members, similarity, words)
    named = (
        members.join(components(links), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("row", "id", "n_shingles", "component")
    )
    # A component of one row is named by the row. The others may be large: their
    # rows are summed up in each task, and only the sums are dealt by component.
    named = stored(named, "components")
    smallest = stored(
        named.groupBy("component")
        .agg(F.min("id").alias("smallest"), F.count("*").alias("n"))
        .where("n > 1")
        .select("component", "smallest"),
        "smallest",
    )
    found = named.join(bounded(smallest, 64), "component", "left")
    found = found.withColumn("component_id", F.coalesce("smallest", "id"))
    return found.select(
        F.col("id").alias(doc_id),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias(
            "kept"
        ),
    )


def _links(
    source: DataFrame, signed: DataFrame, members: DataFrame, similarity: int, words: int
) -> DataFrame:
    """Pairs of a node and a smaller node of its component, one for each at most."""
    nodes = members.where("row = node and n_shingles > 0").select("row")
    buckets = signed.join(nodes, "row", "left_semi").select("row", F.explode("bands").alias("band"))
    lowest = (
        buckets.groupBy("band")
        .agg(F.min("row").alias("low"), F.count("*").alias("n"))
        .where("n > 1")
        .select("band", "low")
    )
    near = buckets.join(lowest, "band").select("row", "low").where("row != low").distinct()
    clusters = components(near)
    chosen = stored(
        signed.join(clusters, signed.row == clusters.node).select(
            "id", "class", "node", F.col("component").alias("cluster"), "sketch"
        ),
        "clusters",
    )
    asked = bounded(chosen, 160)
    sets = stored(
        source.join(asked, source.id.eqNullSafe(asked.id))
        .select("text", "class", "node", "cluster", "sketch")
        .mapInArrow(lambda batches: _sets(batches, words), _SETS),
        "sets",
    )
    weights = sets.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("weight"))
    weights = stored(weights, "weights")
    large = F.col("weight") > TASK_SHINGLES
    total = weights.where(~large).agg(F.sum("weight")).first()[0] or 0
    bins = 1 + total // TASK_SHINGLES
    blocks = F.ceil(F.col("weight") / TASK_SHINGLES).cast("int")
    placed = (
        sets.join(weights, "cluster")
        .withColumn("blocks", F.when(large, blocks).otherwise(F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn(
            "part", F.when(large, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(bins)))
        )
    )
    return (
        placed.select(
            "part",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
            "block",
            "cluster",
            "node",
            "sketch",
            "shingles",
        )
        .groupBy("part", "one", "two")
        .applyInArrow(lambda table: _confirmed(table, similarity), "high long, low long")
    )


def _class_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _shingled(block: Block, words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """The key of each row's words and its set, sorted."""
    found = find_words(block)
    hashes = hash_words(block, found, lower=True)
    grams = hash_windows(hashes, words)
    for first, last in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        own = hashes[first:last]
        if last - first >= words:
            yield _class_key(own), np.unique(grams[first : last - words + 1])
        elif last > first:
            yield _class_key(own), hash_windows(own, last - first)
        else:
            yield b"", np.empty(0, np.uint64)


def _samples(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples, one column per set, of sets that lie one after another."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    return np.stack(
        [
            np.minimum.reduceat((x ^ seed) * factor, starts)
            for seed, factor in zip(_SEEDS, _FACTORS)
        ]
    )


def _folded(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: one row of bytes per set."""
    bits = (samples * _FOLDS[:, None]) >> np.uint32(32 - int(math.log2(SKETCH_BITS)))
    sets = samples.shape[1]
    places = bits.astype(np.int64) + np.arange(sets) * SKETCH_BITS
    odd = np.bincount(places.ravel(), minlength=sets * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, SKETCH_BITS), axis=1)


def _banded(samples: np.ndarray) -> np.ndarray:
    """Band hashes, one row per set."""
    bands = samples.reshape(BANDS, BAND_ROWS, -1).astype(np.uint64)
    found = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] + np.zeros_like(bands[:, 0])
    for row in range(BAND_ROWS):
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + bands[:, row])
    return found.T


@giving_back
def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    numbers = RowNumbers()
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            keys, sets = zip(*_shingled(block, words))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            bands, sketches = np.empty((0, BANDS), np.uint64), [None] * len(sets)
            if len(full):
                starts = np.cumsum(sizes[full]) - sizes[full]
                samples = _samples(np.concatenate([sets[i] for i in full]), starts)
                bands = _banded(samples)
                for row, sketch in zip(full.tolist(), _folded(samples)):
                    sketches[row] = sketch.tobytes()
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, block.high - block.low),
                    pa.array(numbers.take(len(sets))),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes),
                    list_array(bands.ravel().view(np.int64), (sizes > 0) * BANDS, pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                ["id", "row", "class", "n_shingles", "bands", "sketch"],
            )


@giving_back
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Sets of rows whose words are those of the node they were joined with."""
    for batch in batches:
        classes = batch.column("class").to_pylist()
        for block in text_blocks(batch.column("text")):
            kept, sets = [], []
            for row, (key, own) in enumerate(_shingled(block, words), block.low):
                if key == classes[row]:
                    kept.append(row)
                    sets.append(own)
            if not kept:
                continue
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets)
            rows = pa.array(kept)
            yield pa.record_batch(
                [
                    batch.column("node").take(rows),
                    batch.column("cluster").take(rows),
                    batch.column("sketch").take(rows),
                    list_array(flat.view(np.int64), sizes, pa.int64()),
                ],
                ["node", "cluster", "sketch", "shingles"],
            )


def _most_ones(similarity: int) -> float:
    """Ones in the XOR of two sketches that still speak for the similarity."""
    differing = 2 * SAMPLES * (1 - similarity / 100 + SKETCH_MARGIN)
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)


def _confirmed(table: pa.Table, similarity: int) -> pa.Table:
    """Nodes and the smallest node that links reach within these rows."""
    table = table.combine_chunks().sort_by([("cluster", "ascending"), ("node", "ascending")])
    nodes, clusters = table.column("node").to_numpy(), table.column("cluster").to_numpy()
    side = table.column("block").to_numpy() != table.column("one").to_numpy()
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64)
    sketches = sketches.reshape(len(nodes), -1)
    edges = np.flatnonzero(np.diff(clusters)) + 1
    high, low = [], []
    across = bool(table.column("one")[0].as_py() != table.column("two")[0].as_py())
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(nodes)]):
        if last - first < 2:
            continue
        _, ids = np.unique(flat[offsets[first] : offsets[last]], return_inverse=True)
        found = _grouped(
            ids.ravel(),
            offsets[first : last + 1] - offsets[first],
            sketches[first:last],
            side[first:last] if across else None,
            similarity,
        )
        own = nodes[first:last]
        moved = np.flatnonzero(found != np.arange(last - first))
        high.append(own[moved])
        low.append(own[found[moved]])
    none = np.empty(0, np.int64)
    del table, lists, flat
    give_back()
    return pa.table(
        {"high": np.concatenate([none, *high]), "low": np.concatenate([none, *low])}
    )


def _grouped(
    ids: np.ndarray,
    offsets: np.ndarray,
    sketches: np.ndarray,
    side: np.ndarray | None,
    similarity: int,
) -> np.ndarray:
    """For every set the first set that links lead to.

    With ``side``, only pairs of different sides are compared.
    """
    sizes = np.diff(offsets)
    group = np.arange(len(sizes))
    marked = np.zeros(int(ids.max()) + 1, bool)
    most = _most_ones(similarity)
    for row in range(len(sizes) - 1):
        others = np.arange(row + 1, len(sizes))
        others = others[group[others] != group[row]]
        if side is not None:
            others = others[side[others] != side[row]]
        short = np.minimum(sizes[others], sizes[row])
        long = np.maximum(sizes[others], sizes[row])
        others = others[100 * short >= similarity * long]
        if not len(others):
            continue
        ones = np.bitwise_count(sketches[others] ^ sketches[row]).sum(axis=1)
        others = others[ones <= most]
        if not len(others):
            continue
        own = ids[offsets[row] : offsets[row + 1]]
        marked[own] = True
        counts = sizes[others]
        met = marked[ids[ragged(offsets[others], counts)]]
        shared = np.add.reduceat(met.astype(np.int64), np.cumsum(counts) - counts)
        marked[own] = False
        linked = others[100 * shared >= similarity * (sizes[row] + counts - shared)]
        for other in linked.tolist():
            one, two = sorted((int(group[row]), int(group[other])))
            if one != two:
                group[group == two] = one
    return group
