"""Quality scores by a factorisation machine.

Inputs are hashed words, statistics of a text's structure and numeric metadata.
Besides a weight, every input has a vector of ``FACTORS`` numbers, and every pair of
inputs interacts by the product of their vectors. The sum over all pairs is half
the difference between the square of the sum and the sum of the squares, so a
text is scored in time linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    SPACED,
    Block,
    find_words,
    hash_windows,
    hash_words,
    list_array,
    text_blocks,
    window_starts,
)
from tracemill.llm.labelled import first_of_each, held_out, rows_of, training_rows
from tracemill.llm.stored import texts_of

WORD_BITS = 14
FACTORS = 8
LEVELS = 10
# The classifier is fitted on at most this many labelled rows.
TRAINING_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 10, 256, 0.05, 1e-5

_FEATURES = "label int, words array<int>, values array<float>, shape array<float>"

# Kinds of bytes that the structure of a text is told by.
_KINDS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "point": b".,;:?!",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#*$%&|<>",
    "quote": b"\"'()[]{}",
    "wide": range(128, 256),
}
_TABLES = [np.isin(np.arange(256), list(kind)) for kind in _KINDS.values()]


@dataclass
class Machine:
    """A fitted factorisation machine."""

    cuts: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def levels(self, shape: np.ndarray) -> np.ndarray:
        """The input that stands for each statistic's level, after those of the words."""
        found = np.stack(
            [np.searchsorted(cuts, column) for cuts, column in zip(self.cuts, shape.T)], axis=1
        )
        return found + (1 << WORD_BITS) + np.arange(shape.shape[1]) * LEVELS

    def scores(self, words, values, counts, shape) -> np.ndarray:
        """Probabilities of label 1 for rows whose words lie one after another."""
        inputs, values, first = _joined(words, values, counts, self.levels(shape))
        return 1 / (1 + np.exp(-self._sums(inputs, values, first)[0]))

    def _sums(self, inputs, values, first):
        own = self.factors[inputs] * values[:, None]
        total = np.add.reduceat(own, first)
        pairs = (total**2 - np.add.reduceat(own**2, first)).sum(axis=1) / 2
        linear = np.add.reduceat(self.weights[inputs] * values, first)
        return self.bias + linear + pairs, total


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    metadata: Sequence[str] = (),
    threshold: float = 0.3,
    training: int = TRAINING_ROWS,
) -> DataFrame:
    """Scores of all documents by a machine fitted on the labelled ones.

    Returns one row per row of ``docs``: its id, ``held_out``, ``score`` from 0 to 1 and
    ``predicted``, 1 from ``threshold`` on. Rows with a crc32 of their id that 5 divides
    are held out: their labels are not used. ``metadata`` names numeric columns;
    null counts as 0. A null or empty text has no words and is scored by its
    structure. Without labelled rows every score is 0.5. Repeated rows get equal
    scores; equal texts count once in training. No other columns are used.
    """
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in metadata]
    columns = [F.col(text).alias("text"), F.array(*numbers).cast("array<double>").alias("metadata")]
    table = training_rows(
        docs, labels, label, _training_features, _FEATURES, columns, doc_id, training
    )
    machine = fit(table, len(metadata))
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[doc_id].dataType.simpleString()
    return texts_of(
        docs, F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"), *columns
    ).mapInArrow(
        lambda batches: _scored(batches, model.value, threshold),
        f"id {kind}, held_out boolean, score double, predicted int",
    ).withColumnRenamed("id", doc_id)


def fit(table: pa.Table, metadata: int = 0) -> Machine:
    """A machine for rows of ``label``, ``words``, ``values`` and ``shape``."""
    inputs = (1 << WORD_BITS) + (len(_shape_names()) + metadata) * LEVELS
    random = np.random.default_rng(11)
    shapes = len(_shape_names()) + metadata
    machine = Machine(
        np.zeros((shapes, LEVELS - 1)),
        0.0,
        np.zeros(inputs, np.float32),
        random.normal(0, 0.02, (inputs, FACTORS)).astype(np.float32),
    )
    columns = [rows_of(table, name) for name in ("words", "values", "shape")]
    some = first_of_each(*columns)
    if not some:
        return machine
    wanted = table.column("label").to_numpy()[some].astype(np.float32)
    words, values, shape = ([column[i] for i in some] for column in columns)
    shape = np.array(shape, np.float64).reshape(len(some), shapes)
    machine.cuts = np.quantile(shape, np.arange(1, LEVELS) / LEVELS, axis=0).T
    share = np.clip(wanted.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    levels = machine.levels(shape)
    seen_w, seen_v = np.full(inputs, 1e-6), np.full((inputs, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = random.permutation(len(words))
        for low in range(0, len(words), BATCH):
            some = order[low : low + BATCH]
            counts = np.array([len(words[i]) for i in some])
            own, value, first = _joined(
                np.concatenate([words[i] for i in some]).astype(np.int64),
                np.concatenate([values[i] for i in some]),
                counts,
                levels[some],
            )
            sums, total = machine._sums(own, value, first)
            error = (1 / (1 + np.exp(-sums)) - wanted[some]) / len(some)
            sizes = np.diff(np.append(first, len(own)))
            slope = np.repeat(error, sizes) * value
            touched, place = np.unique(own, return_inverse=True)
            step = np.bincount(place, slope, len(touched)) + DECAY * machine.weights[touched]
            seen_w[touched] += step**2
            machine.weights[touched] -= RATE * step / np.sqrt(seen_w[touched])
            total = np.repeat(total, sizes, axis=0)
            pulls = slope[:, None] * (total - machine.factors[own] * value[:, None])
            step = np.stack([np.bincount(place, p, len(touched)) for p in pulls.T], axis=1)
            step += DECAY * machine.factors[touched]
            seen_v[touched] += step**2
            machine.factors[touched] -= RATE * step / np.sqrt(seen_v[touched])
            machine.bias -= RATE * float(error.sum())
    return machine


def _joined(words, values, counts, levels):
    """Inputs of rows one after another: the words of a row, then its levels."""
    each = levels.shape[1]
    first = np.cumsum(counts) - counts + np.arange(len(counts)) * each
    inputs = np.insert(words, np.repeat(np.cumsum(counts), each), levels.ravel())
    values = np.insert(values, np.repeat(np.cumsum(counts), each), np.float32(0.5))
    return inputs, values.astype(np.float32), first


def _shape_names() -> list[str]:
    return [*_KINDS, "words", "length", "distinct", "again", "lines", "line_words", "space"]


def _features(block: Block, metadata: np.ndarray):
    """Word inputs with values, how many each row has, and statistics by row."""
    rows = block.high - block.low
    found = find_words(block)
    hashes = hash_words(block, found, lower=True)
    n = found.counts
    row = found.rows()
    keys = (row.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS))
    keys, times = np.unique(keys, return_counts=True)
    owner = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
    words = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    values = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, values**2, rows))
    values = (values / np.maximum(norm, 1e-9)[owner]).astype(np.float32)
    counts = np.bincount(owner, minlength=rows)
    total = np.maximum(np.diff(block.starts), 1)
    data = block.data

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[block.starts]) / total

    starts = window_starts(found, 4)
    grams = hash_windows(hashes, 4)[starts] if len(starts) else np.empty(0, np.uint64)
    # Runs of four words of a row that stood there before, by a 40-bit hash.
    owners = np.searchsorted(found.first, starts, side="right") - 1
    marks = (owners.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))
    distinct = np.bincount((np.unique(marks) >> np.uint64(40)).astype(np.int64), minlength=rows)
    lines = share(data == 10) * total + 1
    shape = [
        *(share(table[data]) for table in _TABLES),
        np.log1p(n),
        share(SPACED[data]) * total / np.maximum(n, 1),
        counts / np.maximum(n, 1),
        1 - distinct / np.maximum(np.maximum(n - 3, 0), 1),
        np.log1p(lines),
        n / lines,
        share(~SPACED[data]),
        *np.log1p(np.abs(metadata)).T,
    ]
    return words, values, counts, np.stack(shape, axis=1).astype(np.float32)


def _metadata(batch: pa.RecordBatch, block: Block) -> np.ndarray:
    rows = block.high - block.low
    lists = batch.column("metadata").slice(block.low, rows)
    return lists.flatten().to_numpy().reshape(rows, -1)


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, values, counts, shape = _features(block, _metadata(batch, block))
            each = np.full(len(shape), shape.shape[1])
            yield pa.record_batch(
                [
                    batch.column("label").slice(block.low, block.high - block.low),
                    list_array(words.astype(np.int32), counts, pa.int32()),
                    list_array(values, counts, pa.float32()),
                    list_array(shape.ravel(), each, pa.float32()),
                ],
                ["label", "words", "values", "shape"],
            )


def _scored(
    batches: Iterator[pa.RecordBatch], machine: Machine, threshold: float
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, values, counts, shape = _features(block, _metadata(batch, block))
            scores = machine.scores(words, values, counts, shape.astype(np.float64))
            scores = scores.astype(np.float64)
            rows = block.high - block.low
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, rows),
                    batch.column("held_out").slice(block.low, rows),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                ["id", "held_out", "score", "predicted"],
            )
