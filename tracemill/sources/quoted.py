"""Csv records that go over the ends of lines, from files that many tasks read.

A line's end inside quotes belongs to a text. Whether a place is inside quotes depends on
all that comes before it in the file, yet a large file is dealt to many tasks. So each
task first finds what its share does to either state, inside or outside: a map of two
values. These maps are put together along each file, which gives the state in which every
share begins; then the shares are cut into records. What is left of a record at the end
of a share is joined with what comes first in the next ones.

Only files that have a line with an odd number of quotes are read like this; Spark's
reader is right for the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.joins import BROADCAST_BYTES
from tracemill.session import durable
from tracemill.sources.runs import literal, source_path

# A share's state in the lookup of states: path, offset, flags.
_STATE_BYTES = 512

# How a quoted text is written: a quote in it is doubled, and a backslash is
# a character like others.
QUOTING = {"escape": '"'}
_REST_OF_QUOTED = re.compile('(?:[^"]|"")*')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, if it begins so or not.

    A quote opens a text only where a value begins; elsewhere it is a character.
    """
    if '"' not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = _REST_OF_QUOTED.match(line, at).end()
        if end >= size:
            return True
        inside = False
        at = line.find(",", end + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, places: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Lines of files in order within each share of a file: path, offset of the share, text."""
    # The reader's own line ends would take carriage returns out of texts.
    reader = spark.read.options(lineSep="\n", **options)
    return reader.text([literal(place) for place in places]).select(
        plain_path(source_path(F.col("_metadata.file_path"))).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("text"),
    )


def plain_path(path):
    """A path whose local scheme is written in one way."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def torn_files(spark: SparkSession, places: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Paths of the files that have a line with an odd number of quotes, stored."""
    odd = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    lines = _lines(spark, places, options).where(F.col("text").contains('"'))
    found = lines.groupBy("path").agg(F.max(odd % 2).alias("odd"))
    return durable(found.where("odd = 1").select("path"))


def csv_records(spark: SparkSession, places: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Records of csv files without their headers: ``path``, ``start``, ``text``.

    ``start`` is the offset of the share of the file in which a record begins. Two passes
    over the files; a record ends where a line ends outside quotes. Empty lines between
    records are none.
    """
    lines = _lines(spark, places, options)
    maps = durable(
        lines.mapInArrow(
            _share_maps,
            "path string, start long, from_outside boolean, from_inside boolean, closes boolean",
        )
    )
    states = durable(
        maps.groupBy("path").applyInPandas(_share_states, "path string, start long, inside boolean, opened long")
    )
    # As many rows as shares. Beyond the bound, files are taken in several goes.
    goes = 1 + states.count() * _STATE_BYTES // BROADCAST_BYTES
    pieces = None
    for go in range(goes):
        own = states.where(F.pmod(F.xxhash64("path"), F.lit(goes)) == go)
        known = lines.join(F.broadcast(own), ["path", "start"])
        found = known.select("path", "start", "text", "inside", "opened").mapInArrow(
            _cut_records, "path string, opened long, place long, start long, text string, whole boolean"
        )
        pieces = found if pieces is None else pieces.unionByName(found)
    whole = pieces.where("whole").select("path", F.col("opened"), "place", "text")
    # The parts of one record, from the end of a share and the beginnings of later ones.
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    torn = (
        pieces.where("not whole")
        .groupBy("path", "opened")
        .agg(F.max("place").alias("place"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    )
    records = whole.unionByName(torn.select("path", "opened", "place", "text"))
    header = (F.col("opened") == 0) & (F.col("place") == 0)
    text = F.regexp_replace("text", r"\r$", "")
    found = records.where(~header).select("path", F.col("opened").alias("start"), text.alias("text"))
    return found.where("text != ''")


def _share_maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each share does to the state before it."""
    held, outside, inside, closes = None, False, True, False

    def row() -> pa.RecordBatch:
        names = ("path", "start", "from_outside", "from_inside", "closes")
        return pa.RecordBatch.from_pylist([dict(zip(names, (*held, outside, inside, closes)))])

    for batch in batches:
        for path, start, text in zip(*(column.to_pylist() for column in batch.columns)):
            if (path, start) != held:
                if held is not None:
                    yield row()
                held, outside, inside, closes = (path, start), False, True, False
            if '"' in text:
                outside, inside = ends_inside(text, outside), ends_inside(text, inside)
                closes = closes or not inside  # a record that began before ends here
    if held is not None:
        yield row()


def _share_states(shares: pd.DataFrame) -> pd.DataFrame:
    """The state in which each share of a file begins, and where a record left open began."""
    shares = shares.sort_values("start")
    inside, opened, out = False, 0, []
    for share in shares.itertuples():
        out.append((share.path, share.start, inside, opened))
        after = bool(share.from_inside if inside else share.from_outside)
        if after and (share.closes or not inside):
            opened = share.start
        inside = after
    return pd.DataFrame(out, columns=["path", "start", "inside", "opened"])


def _cut_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of shares; parts of records where a share begins or ends inside quotes."""
    names = ["path", "opened", "place", "start", "text", "whole"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))
    held, out, pending, inside, first, place, size = None, [], [], False, 0, 0, 0

    def close(whole: bool) -> None:
        nonlocal place, pending, size, first
        text = "\n".join(pending)
        # A part that continues a record has that record's beginning, and no place.
        owner, number = (first, -1) if first is not None else (held[1], place)
        out.append((held[0], owner, number, held[1], text, whole and first is None))
        place, size, pending, first = place + 1, size + len(text), [], None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema=schema)

    for batch in batches:
        for path, start, text, begins, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, start) != held:
                if pending:
                    close(False)
                held, inside, place, pending = (path, start), begins, 0, []
                first = opened if begins else None
            pending.append(text)
            inside = ends_inside(text, inside)
            if not inside:
                close(True)
            if len(out) >= 10_000 or size > 1 << 22:
                yield made()
                out, size = [], 0
    if pending:
        close(False)
    if out:
        yield made()
