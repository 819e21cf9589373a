"""Removal of word runs that stand anywhere else, by difference-cover anchors.

A window is ``window`` consecutive words. Positions that are, modulo a period, in a
difference cover are anchors: whatever the positions of two equal windows, at some
offset below the period both have an anchor. So the short runs at anchors are
hashed and counted first, about a quarter of all positions, and a window is a
candidate only if one of its anchors stands twice. Around such anchors the match
is then extended to whole windows, which are counted by a hash of all their words.

Only counts are shuffled, summed up before they move, and then the places of
candidate windows that turned out to stand once, and the texts that have some.
Whole copies, however many there are, are counted through one of them; they are
never paired or gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    Block,
    Words,
    covered,
    find_words,
    hash_windows,
    hash_words,
    text_blocks,
    window_starts,
)
from tracemill.llm.stored import BitFilter, RowNumbers, bit_filter, bounded, stored, texts_of

# Every difference modulo the period is one of two cover positions.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

# Compressed texts that are unpacked at once.
UNPACKED_ROWS = 500


def drop_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 35,
    digest: bool = False,
) -> DataFrame:
    """Every document without the words that repeated windows cover.

    Words are runs of characters that are no ASCII white space. A word is removed if
    a window over it has the same words as a window that begins anywhere else, in
    the same document or another; all windows are judged on the input. Returns one
    row per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept``, the other
    words joined by blanks, or their SHA-256 in hex with ``digest``. A null, empty
    or short text loses nothing; null gives an empty ``kept``. Repeated rows count as
    documents of their own, so they lose what they share. Rows need no id. Other
    columns are not used. ``window`` is more than 21.
    """
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    kind = docs.schema[doc_id].dataType.simpleString()
    source = texts_of(docs, F.col(doc_id).alias("id"), F.col(text).alias("text"))
    anchors = source.select("text").mapInArrow(lambda rows: _anchors(rows, window), "hash long")
    twice = stored(
        anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"),
        "anchors",
    )
    met = bit_filter(twice, twice.count())
    rows = stored(
        source.mapInArrow(
            lambda batches: _settled(batches, met, window, digest),
            f"id {kind}, row long, n_words long, class binary, kept string, open binary",
        ),
        "texts",
    )
    # Whole copies lose all their words. One of them stands for all where windows are
    # counted, as often as twice.
    classes = (
        rows.where("class is not null")
        .groupBy("class")
        .agg(F.min("row").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("class", "first")
    )
    classes = bounded(stored(classes, "classes"), 64)
    copies = stored(rows.select("row", "class").join(classes, "class").select("row", "first"), "copies")
    told = rows.join(bounded(copies, 32), "row", "left")
    windows = (
        told.where("open is not null and (first is null or first = row)")
        .select("row", F.col("open").alias("text"), F.col("first").isNotNull().alias("copied"))
        .mapInArrow(
            lambda batches: _windows(batches, met, window),
            "hash long, check int, n int, place long, row long",
        )
    )
    # A window that stands once has one place, which the minima then name.
    once = (
        windows.groupBy("hash", "check")
        .agg(F.sum("n").alias("n"), F.min("row").alias("row"), F.min("place").alias("place"))
        .where("n = 1")
        .groupBy("row")
        .agg(F.collect_list("place").alias("single"))
    )
    left = told.where("open is not null and first is null").join(once, "row", "left")
    some = left.select("id", "n_words", "open", "single").mapInArrow(
        lambda batches: _removed(batches, met, window, digest),
        f"id {kind}, n_words long, n_removed long, kept string",
    )
    none = told.where("open is null and first is null").select(
        "id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept"
    )
    every = told.where("first is not null").select(
        "id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_digested("", digest)).alias("kept")
    )
    return some.unionByName(none).unionByName(every).withColumnRenamed("id", doc_id)


def _anchor_starts(words: Words, size: int) -> np.ndarray:
    starts = window_starts(words, size)
    inside = starts - words.first[np.searchsorted(words.first, starts, side="right") - 1]
    return starts[np.isin(inside % PERIOD, COVER)]


def _hashed(block: Block) -> tuple[Words, np.ndarray]:
    words = find_words(block)
    return words, hash_words(block, words)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    size = window - PERIOD + 1
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, hashes = _hashed(block)
            # Only texts that have a whole window can lose anything.
            starts = _anchor_starts(words, size)
            if len(starts):
                rows = np.searchsorted(words.first, starts, side="right") - 1
                starts = starts[words.counts[rows] >= window]
                found = hash_windows(hashes, size)[starts]
                yield pa.record_batch([pa.array(found.view(np.int64))], ["hash"])


def _candidates(words: Words, hashes: np.ndarray, met: BitFilter, window: int) -> np.ndarray:
    """First words of windows with an anchor that may stand twice."""
    size = window - PERIOD + 1
    starts = _anchor_starts(words, size)
    if not len(starts):
        return starts
    starts = starts[met.may_hold(hash_windows(hashes, size)[starts])]
    # An anchor is in the windows that begin up to a period before it.
    near = covered(starts, PERIOD, len(hashes) + PERIOD)[PERIOD - 1 :]
    whole = window_starts(words, window)
    return whole[near[whole]]


def _texts(block: Block, words: Words) -> list[str]:
    """The words of every row, joined by blanks."""
    data = block.data.copy()
    inside = np.zeros(len(data), bool)
    if len(data):
        change = np.zeros(len(data) + 1, np.int8)
        change[words.begin] += 1
        change[words.end] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    data[~inside] = 32
    # Of every gap one blank stays, right after the word.
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    ends = np.concatenate([[0], np.cumsum(keep)])[block.starts].tolist()
    flat = data[keep].tobytes()
    return [flat[a:b].decode().strip(" ") for a, b in zip(ends, ends[1:])]


def _digested(text: str, digest: bool) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if digest else text


def _settled(
    batches: Iterator[pa.RecordBatch], met: BitFilter, window: int, digest: bool
) -> Iterator[pa.RecordBatch]:
    """Results of texts without candidates; the words of the others, compressed.

    ``class`` names the words of a text that has a whole window.
    """
    numbers = RowNumbers()
    packer = zstandard.ZstdCompressor()
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            words, hashes = _hashed(block)
            starts = _candidates(words, hashes, met, window)
            rows = np.searchsorted(words.first, starts, side="right") - 1
            pending = (np.bincount(rows, minlength=block.high - block.low) > 0).tolist()
            texts = _texts(block, words)
            classes = [
                hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
                if b - a >= window
                else None
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())
            ]
            kept = [None if p else _digested(t, digest) for t, p in zip(texts, pending)]
            left = [packer.compress(t.encode()) if p else None for t, p in zip(texts, pending)]
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, block.high - block.low),
                    pa.array(numbers.take(len(texts))),
                    pa.array(words.counts),
                    pa.array(classes, pa.binary()),
                    pa.array(kept, pa.string()),
                    pa.array(left, pa.binary()),
                ],
                ["id", "row", "n_words", "class", "kept", "open"],
            )


def _unpacked(column: pa.Array, low: int, high: int) -> pa.Array:
    """Texts of some rows; null is empty."""
    unpacker = zstandard.ZstdDecompressor()
    packed = column.slice(low, high - low).to_pylist()
    texts = [unpacker.decompress(p).decode() if p else "" for p in packed]
    return pa.array(texts, pa.large_string())


def _windows(
    batches: Iterator[pa.RecordBatch], met: BitFilter, window: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("row").to_numpy()
        times = 1 + batch.column("copied").to_numpy(zero_copy_only=False).astype(np.int32)
        for low in range(0, batch.num_rows, UNPACKED_ROWS):
            high = min(low + UNPACKED_ROWS, batch.num_rows)
            for block in text_blocks(_unpacked(batch.column("text"), low, high)):
                words, hashes = _hashed(block)
                starts = _candidates(words, hashes, met, window)
                if not len(starts):
                    continue
                rows = np.searchsorted(words.first, starts, side="right") - 1
                check = hash_windows(hashes, window, 1)[starts] >> np.uint64(32)
                at = low + block.low + rows
                yield pa.record_batch(
                    [
                        pa.array(hash_windows(hashes, window)[starts].view(np.int64)),
                        pa.array(check.astype(np.uint32).view(np.int32)),
                        pa.array(times[at]),
                        pa.array(starts - words.first[rows]),
                        pa.array(numbers[at]),
                    ],
                    ["hash", "check", "n", "place", "row"],
                )


def _removed(
    batches: Iterator[pa.RecordBatch], met: BitFilter, window: int, digest: bool
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, UNPACKED_ROWS):
            part = batch.slice(low, UNPACKED_ROWS)
            kept: list[str] = []
            gone: list[np.ndarray] = []
            for block in text_blocks(_unpacked(part.column("open"), 0, part.num_rows)):
                words, hashes = _hashed(block)
                starts = _candidates(words, hashes, met, window)
                # Windows that stand once are taken out of the candidates.
                own = part.column("single").slice(block.low, block.high - block.low)
                counts = own.value_lengths().fill_null(0).to_numpy()
                alone = own.flatten().to_numpy() + np.repeat(words.first[:-1], counts)
                starts = starts[~np.isin(starts, alone)]
                out = covered(starts, window, len(hashes) + window)[: len(hashes)]
                total = np.concatenate([[0], np.cumsum(out)])
                gone.append(total[words.first[1:]] - total[words.first[:-1]])
                for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    text = _joined_words(block, words, first, last, ~out[first:last])
                    kept.append(_digested(text, digest))
            yield pa.record_batch(
                [
                    part.column("id"),
                    part.column("n_words"),
                    pa.array(np.concatenate(gone)),
                    pa.array(kept, pa.string()),
                ],
                ["id", "n_words", "n_removed", "kept"],
            )


def _joined_words(block: Block, words: Words, low: int, high: int, keep: np.ndarray) -> str:
    """The kept ones of a row's words, joined by blanks."""
    if low == high:
        return ""
    origin = int(words.begin[low])
    data = block.data[origin : words.end[high - 1]].tobytes()
    begin, end = words.begin[low:high][keep] - origin, words.end[low:high][keep] - origin
    return b" ".join([data[a:b] for a, b in zip(begin.tolist(), end.tolist())]).decode()
