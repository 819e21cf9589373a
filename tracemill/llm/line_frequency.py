"""Quality rules: text statistics, and lines that many documents of a host share.

Statistics of a text are taken in one pass over its bytes. Lines are normalised
and hashed, distinct documents are counted for every host and line, and lines
above a host's limit are boilerplate: their words are taken out, and a document
that keeps too few of its words is rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    SPACED,
    Block,
    Words,
    covered,
    find_words,
    hash_windows,
    hash_words,
    list_array,
    text_blocks,
    window_starts,
)
from tracemill.llm.stored import RowNumbers, stored, texts_of

# Symbols that are counted.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the quality rules."""

    min_words: int = 20
    repeat_window: int = 8
    most_repeat_percent: int = 30
    # A line is boilerplate if more documents of its host have it than both of these.
    line_docs: int = 20
    line_share: float = 0.02
    # A document is depleted if fewer of its words are outside boilerplate.
    least_left_percent: int = 30


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    rules: Rules = Rules(),
    cleaned: str | None = None,
) -> DataFrame:
    """Statistics and verdict of every document.

    Returns one row per row of ``docs``: its id, ``n_words``, ``word_chars`` (code
    points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an
    earlier one), ``n_repeat_words`` (words in windows that stand twice in the text),
    ``base_failed``, ``n_boilerplate`` (words in lines above the host's limit),
    ``boilerplate`` (numbers of these lines, from 0) and ``kept``. Words are runs of
    characters that are no ASCII white space; a null text has none. A line counts
    once per document; its normal form has A-Z as a-z, every run of digits as 0, and
    single blanks. Documents without a host are a host of their own together.
    Repeated rows count as documents. Other columns are not used.

    ``cleaned`` names a column for the text without its boilerplate lines, the others
    joined by ``\\n`` as they were; null where the text is null.

    A host's limit rises with its documents: where it has 2 % of a million, a line that
    19 000 of them share stays. The count (``line_docs``) is what binds hosts of up to 1000
    documents; a smaller ``line_share`` is the way to judge large hosts more strictly.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = stored(
        texts_of(
            docs, F.col(doc_id).alias("id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")
        ).mapInArrow(
            lambda batches: _statistics(batches, rules.repeat_window, cleaned is not None),
            f"id {kind}, host string, row long, n_words long, word_chars long, n_symbols long, "
            "n_dup_lines long, n_repeat_words long, lines array<binary>, line_words array<int>"
            + (", text string" if cleaned else ""),
        ),
        "statistics",
    )
    lines = rows.select(
        "host", "row", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "line")
    ).select("host", "row", "place", F.col("line.lines").alias("line"), F.col("line.line_words").alias("words"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(rules.line_docs), F.col("host_docs") * rules.line_share)
    distinct = rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    often = stored(
        distinct.where("line is not null")
        .groupBy("host", "line")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") > rules.line_docs)
        .join(sizes.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("docs") > limit)
        .select(F.col("host").alias("of"), F.col("line").alias("common")),
        "common-lines",
    )
    found = (
        lines.join(
            often, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("common"))
        )
        .groupBy("row")
        .agg(
            F.sum("words").cast("long").alias("n_boilerplate"),
            F.sort_array(F.collect_list("place")).alias("boilerplate"),
        )
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words")
    )
    left = 100 * (F.col("n_words") - F.col("n_boilerplate"))
    judged = (
        rows.drop("host", "lines", "line_words")
        .join(found, "row", "left")
        .withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
        .withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<int>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= rules.least_left_percent * F.col("n_words")))
        .drop("row")
    )
    if cleaned:
        stays = F.filter(
            F.split("text", "\n", -1), lambda _, place: ~F.array_contains("boilerplate", place)
        )
        judged = judged.withColumn("text", F.array_join(stays, "\n"))
        judged = judged.withColumnRenamed("text", cleaned)
    return judged.withColumnRenamed("id", doc_id)


_DIGITS = re.compile(rb"[0-9]+")


def _line_key(line: bytes) -> bytes:
    return hashlib.blake2b(
        _DIGITS.sub(b"0", b" ".join(line.lower().split())), digest_size=16
    ).digest()


def _repeat_words(words: Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """For every row, words in windows whose words stand twice in the row."""
    starts = window_starts(words, size)
    if not len(starts):
        return np.zeros(len(words.first) - 1, np.int64)
    found = hash_windows(hashes, size)[starts]
    rows = np.searchsorted(words.first, starts, side="right") - 1
    order = np.lexsort((found, rows))
    same = (found[order][1:] == found[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = covered(starts[twice], size, len(hashes) + size)[: len(hashes)]
    return _sums(inside, words.first)


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags from ``first[i]`` to ``first[i + 1]``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _line_statistics(block: Block) -> tuple[list, list, np.ndarray]:
    """Keys and word counts of every row's lines, and lines that equal earlier ones."""
    keys, counts, again = [], [], np.zeros(block.high - block.low, np.int64)
    for row in range(block.high - block.low):
        lines = block.text(row).split(b"\n")
        words = [len(line.split()) for line in lines]
        seen = {line for line, n in zip(lines, words) if n}
        again[row] = sum(n > 0 for n in words) - len(seen)
        keys.append([_line_key(line) if n else None for line, n in zip(lines, words)])
        counts.append(words)
    return keys, counts, again


def _statistics(
    batches: Iterator[pa.RecordBatch], size: int, with_text: bool = False
) -> Iterator[pa.RecordBatch]:
    numbers = RowNumbers()
    for batch in batches:
        for block in text_blocks(batch.column("text")):
            rows = block.high - block.low
            words = find_words(block)
            hashes = hash_words(block, words)
            points = SPACED[block.data] & ((block.data & 0xC0) != 0x80)
            keys, counts, again = _line_statistics(block)
            sizes = np.fromiter(map(len, keys), np.int64, rows)
            yield pa.record_batch(
                [
                    batch.column("id").slice(block.low, rows),
                    batch.column("host").slice(block.low, rows),
                    pa.array(numbers.take(rows)),
                    pa.array(words.counts),
                    pa.array(_sums(points, block.starts)),
                    pa.array(_sums(_SYMBOLS[block.data], block.starts)),
                    pa.array(again),
                    pa.array(_repeat_words(words, hashes, size)),
                    list_array([k for own in keys for k in own], sizes, pa.binary()),
                    list_array([n for own in counts for n in own], sizes, pa.int32()),
                    *([batch.column("text").slice(block.low, rows)] if with_text else []),
                ],
                [
                    "id", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "lines", "line_words", *(["text"] if with_text else []),
                ],
            )
