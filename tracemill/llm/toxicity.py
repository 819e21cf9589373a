"""Toxicity scores by a counterfactually regularised classifier.

A linear classifier over the distinct words of a text and how they begin: an insult
comes in many forms of which few are in the labelled texts. Labelled texts that name a
group are also read with the group's name swapped for those of other groups, and
the change of the score is penalised. A name that happens to stand in toxic texts
more often than others thus gets no weight of its own, and neutral mentions of a
group are not taken for attacks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    ALNUM,
    Block,
    Words,
    find_words,
    giving_back,
    hash_words,
    list_array,
    mixed,
    text_blocks,
)
from tracemill.llm.labelled import first_of_each, held_out, rows_of, training_rows
from tracemill.llm.stored import texts_of

WORD_BITS = 20
# The classifier is fitted on at most this many labelled rows.
TRAINING_ROWS = 20_000
# A word is an input if so many training texts have it and its rate of toxic texts
# lies so many standard errors from that of all.
LEAST_TEXTS, LEAST_ERRORS = 5, 4.0
STEPS, RATE, RIDGE, SWAP_PENALTY = 400, 0.05, 1e-3, 1.0
# Training texts that are looked at together.
PART = 500
# A word of more bytes is also known by its first ones.
BEGINNINGS = (4, 5)

# Names of groups that are swapped for one another.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "muslims", "muslim", "christians",
    "christian", "jews", "jewish", "hindus", "buddhists", "atheists", "black", "white",
    "asian", "african", "latino", "arab", "gay", "lesbian", "straight", "transgender",
    "immigrants", "refugees", "foreigners", "disabled", "deaf", "blind", "old", "young",
)


@dataclass
class Classifier:
    """Weights of hashed words."""

    bias: float
    weights: np.ndarray

    def scores(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(counts)), counts)
        sums = self.bias + np.bincount(rows, self.weights[words], len(counts))
        return 1 / (1 + np.exp(-np.clip(sums, -60, 60)))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = 0.5,
    identity_terms: Sequence[str] = IDENTITY_TERMS,
    training: int = TRAINING_ROWS,
    swap_penalty: float = SWAP_PENALTY,
    row: str | None = None,
) -> DataFrame:
    """Scores of all documents by a classifier fitted on the labelled ones.

    Returns one row per row of ``docs``: its id, ``held_out``, ``score`` from 0 to 1 and
    ``predicted``, 1 from ``threshold`` on. Rows with a crc32 of their id that 5 divides
    are held out: their labels are not used. Words are runs of ASCII letters and
    digits and of other characters outside ASCII, with A-Z as a-z. A null or empty
    text has no words and gets the score of the bias. Without labelled rows, or with
    none that is toxic, scores stay at the share of toxic rows, at least 0.01.
    Repeated rows get equal scores; equal texts count once in training. A column
    ``row`` of longs is returned with its row. No other columns are used.
    """
    terms, begun = _term_hashes(identity_terms)
    table = training_rows(
        docs,
        labels,
        label,
        lambda batches: _training_features(batches, terms),
        "label int, words array<int>, swapped array<int>",
        [F.col(text).alias("text")],
        doc_id,
        training,
    )
    fitted = fit(table, terms, swap_penalty, begun)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = texts_of(
        docs,
        F.col(doc_id).alias("id"),
        held_out(F.col(doc_id)).alias("held_out"),
        F.col(text).alias("text"),
        (F.col(row) if row else F.lit(None)).cast("long").alias("number"),
    ).mapInArrow(
        lambda batches: _scored(batches, model.value, threshold),
        f"id {kind}, held_out boolean, score double, predicted int, number long",
    )
    found = scored.withColumnRenamed("id", doc_id)
    return found.withColumnRenamed("number", row) if row else found.drop("number")


def fit(
    table: pa.Table,
    terms: np.ndarray,
    swap_penalty: float = SWAP_PENALTY,
    begun: np.ndarray = np.empty(0, np.int64),
) -> Classifier:
    """A classifier for rows of ``label``, ``words`` and ``swapped``.

    ``swapped`` has pairs of words: one of the text, and one that takes its place.
    ``begun`` are buckets that get no weight: how names of groups begin, which a swap
    of whole names would not even out.
    """
    texts, swapped = rows_of(table, "words"), rows_of(table, "swapped")
    some = first_of_each(texts)
    labels = table.column("label").to_numpy()[some].astype(np.float64)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    weights = np.zeros(1 << WORD_BITS)
    result = Classifier(float(np.log(share / (1 - share))), weights)
    if not labels.any() or labels.all():
        return result
    # A few texts at a time: their words are many, the inputs among them are few.
    parts = [range(low, min(low + PART, len(some))) for low in range(0, len(some), PART)]

    def words_of(part: range) -> tuple[np.ndarray, np.ndarray]:
        own = [texts[some[i]] for i in part]
        return np.concatenate(own), np.repeat(np.array(part), [len(w) for w in own])

    having, toxic = np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS)
    for part in parts:
        words, owner = words_of(part)
        having += np.bincount(words, minlength=1 << WORD_BITS)
        toxic += np.bincount(words, labels[owner], 1 << WORD_BITS)
    having = np.maximum(having, 1)
    error = np.sqrt(share * (1 - share) / having)
    chosen = (having >= LEAST_TEXTS) & (np.abs(toxic / having - share) >= LEAST_ERRORS * error)
    chosen[begun] = False
    chosen[_buckets(terms)] = True
    inputs = np.flatnonzero(chosen)
    number = np.zeros(1 << WORD_BITS, np.int64)
    number[inputs] = np.arange(len(inputs))
    kept = [(number[w[chosen[w]]], owner[chosen[w]]) for w, owner in map(words_of, parts)]
    words, owner = (np.concatenate(column) for column in zip(*kept))
    pairs = number[np.concatenate([swapped[i] for i in some]).astype(np.int64).reshape(-1, 2)]
    w, bias = np.zeros(len(inputs)), result.bias
    mean, square = np.zeros(len(inputs) + 1), np.zeros(len(inputs) + 1)
    for step in range(1, STEPS + 1):
        sums = bias + np.bincount(owner, w[words], len(labels))
        wrong = (1 / (1 + np.exp(-np.clip(sums, -60, 60))) - labels) / len(labels)
        slope = np.bincount(words, wrong[owner], len(inputs)) + RIDGE * w / len(inputs) ** 0.5
        if len(pairs):
            change = 2 * swap_penalty * (w[pairs[:, 0]] - w[pairs[:, 1]]) / len(pairs)
            slope += np.bincount(pairs[:, 0], change, len(inputs))
            slope -= np.bincount(pairs[:, 1], change, len(inputs))
        slope = np.append(slope, wrong.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[inputs] = w
    return Classifier(float(bias), weights)


def _term_hashes(terms: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the identity terms, each of them one word, and buckets of their beginnings."""
    hashes, begun = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for block in text_blocks(pa.array(list(terms), pa.string())):
        words, found = _block_words(block)
        hashes.append(found)
        begun.append(_keys(block, words, found)[len(found) :] & ((1 << WORD_BITS) - 1))
    return np.unique(np.concatenate(hashes)), np.unique(np.concatenate(begun))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _block_words(block: Block) -> tuple[Words, np.ndarray]:
    words = find_words(block, ALNUM)
    return words, hash_words(block, words, lower=True)


def _keys(block: Block, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Row and bucket of every word and of every beginning of a longer one."""
    rows, sizes = words.rows(), words.end - words.begin
    keys = [(rows << WORD_BITS) | _buckets(hashes)]
    for size in BEGINNINGS:
        long = np.flatnonzero(sizes > size)
        first = np.searchsorted(long, words.first)
        begun = Words(words.begin[long], words.begin[long] + size, first)
        marked = mixed(hash_words(block, begun, lower=True) + np.uint64(size))
        keys.append((rows[long] << WORD_BITS) | _buckets(marked))
    return np.concatenate(keys)


def _distinct(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every row, and how many there are."""
    keys = np.unique(keys)
    return keys & ((1 << WORD_BITS) - 1), np.bincount(keys >> WORD_BITS, minlength=rows)


@giving_back
def _training_features(
    batches: Iterator[pa.RecordBatch], terms: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Words of every text, and which of them stand for which when groups are swapped."""
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, hashes = _block_words(block)
            rows = block.high - block.low
            own, counts = _distinct(_keys(block, words, hashes), rows)
            swaps: list[list[int]] = []
            named = np.isin(hashes, terms)
            for first, last in zip(words.first[:-1], words.first[1:]):
                here = np.unique(hashes[first:last][named[first:last]])
                others = terms[~np.isin(terms, here)]
                pairs = [np.repeat(here, len(others)), np.tile(others, len(here))]
                swaps.append(_buckets(np.stack(pairs, axis=1).ravel()).tolist())
            yield pa.record_batch(
                [
                    batch.column("label").slice(block.low, rows),
                    list_array(own.astype(np.int32), counts, pa.int32()),
                    pa.array(swaps, pa.list_(pa.int32())),
                ],
                ["label", "words", "swapped"],
            )


@giving_back
def _scored(
    batches: Iterator[pa.RecordBatch], model: Classifier, threshold: float
) -> Iterator[pa.RecordBatch]:
    weighty = model.weights != 0
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, hashes = _block_words(block)
            rows = block.high - block.low
            keys = _keys(block, words, hashes)
            keys = keys[weighty[keys & ((1 << WORD_BITS) - 1)]]
            scores = model.scores(*_distinct(keys, rows))
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, rows),
                    batch.column("held_out").slice(block.low, rows),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    batch.column("number").slice(block.low, rows),
                ],
                ["id", "held_out", "score", "predicted", "number"],
            )
