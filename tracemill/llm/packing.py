"""Best-fit packing of documents into sequences by bin completion.

A piece's length is all that packing needs, and there are no more lengths than
tokens in a sequence. So the search works on the count of every length, and its
size does not grow with the corpus: a filling is a list of lengths, made as often
as the counts allow. Bin completion takes the longest length that is left and
enumerates the undominated fillings around it, least waste first; a branch ends
when its waste shows that it cannot need fewer sequences than the best solution
so far, of which the first is best fit in decreasing order. Pieces are then
numbered within their length and look up their place.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import text_blocks
from tracemill.llm.stored import stored, texts_of
from tracemill.llm.token_files import BLOCK_BYTES, with_end
from tracemill.llm.tokens import encoder

# The search is cut off after so many steps, and the best solution counts. Every
# step fills one kind of bin; fillings of one bin are looked for in as many.
SEARCH_STEPS = 8_000
FILLING_STEPS = 400
FILLINGS = 4

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = 2048,
    end: int = 0,
) -> DataFrame:
    """Encoded documents cut to at most ``most`` tokens.

    One row per piece: its document's id, ``piece`` from 0, ``start`` in its
    document, ``length`` and ``ids_crc32``. A document ends with ``end``; a null text
    is empty. Only longer documents are cut, and only the first piece is shorter
    than ``most``. Repeated documents are all there.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return texts_of(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda batches: _pieces(batches, tokenizer, most, end),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


def pack(rows: DataFrame, most: int = 2048, length: str = "length") -> DataFrame:
    """Rows with ``sequence_id`` and ``offset``, in as few sequences as are found.

    Every row goes to one sequence, without gaps from offset 0. Rows of length 0
    or null are in no sequence: both columns are null. Other columns are kept; a
    clash with ``sequence_id`` or ``offset`` is overwritten. A length above ``most``
    is an error. Equal lengths are numbered in the order of their stored rows, so
    ties and repeated rows each get a place of their own.
    """
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    size = F.col(f"`{length}`").cast("long")
    wide = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("own"), size.alias("size"))
    kept = stored(
        wide.select(
            "own",
            F.when(F.col("size") > most, F.raise_error(F.lit("a row is longer than a sequence")))
            .otherwise(F.col("size"))
            .alias("size"),
        ),
        "pieces",
    )
    block = F.col("_metadata.file_path")
    fits = kept.where("size > 0").withColumn("block", block)
    # Counts of every length in every written file: as many rows as files times lengths.
    counts = stored(fits.groupBy("size", "block").agg(F.count("*").alias("n")), "lengths")
    total = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = kept.sparkSession.sparkContext.broadcast(_places(bin_completion(total, most)))
    order = Window.partitionBy("size").orderBy("block")
    first = counts.select(
        "size",
        "block",
        F.coalesce(
            F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("first"),
    )
    within = Window.partitionBy("size", "block").orderBy("place")
    numbered = (
        fits.withColumn("place", F.monotonically_increasing_id())
        # Grows with the files, so it is never sent whole to every executor.
        .join(first.hint("merge"), ["size", "block"])
        .withColumn("number", F.col("first") + F.row_number().over(within) - 1)
    )
    own = kept.schema["own"].dataType.simpleString()
    placed = numbered.select("size", "number", "own").mapInArrow(
        lambda batches: _look_up(batches, plan.value),
        f"own {own}, sequence_id long, offset long",
    )
    none = kept.where("size <= 0 or size is null").select(
        "own", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")
    )
    return placed.unionByName(none).select("own.*", "sequence_id", "offset")


def bin_completion(counts: dict[int, int], most: int, steps: int = SEARCH_STEPS) -> Plan:
    """Fillings and how often each is made, for ``counts`` of every length."""
    best = _best_fit(counts, most)
    total = sum(size * n for size, n in counts.items())
    fewest = _fewest(counts, most)
    bins = sum(n for _, n in best)
    left = dict(counts)
    chosen: list[tuple[Filling, int]] = []
    waste = made = 0
    # One entry per open choice: the fillings not tried yet.
    open_choices: list[list[Filling]] = []
    while bins > fewest and steps > 0:
        sizes = sorted(size for size, n in left.items() if n)
        if not sizes:
            if made < bins:
                best, bins = list(chosen), made
        elif waste <= (bins - 1) * most - total:
            open_choices.append(_fillings(left, sizes, most)[::-1])
            steps -= 1
        while open_choices:
            if len(chosen) == len(open_choices):  # undo the last try of this choice
                filling, n = chosen.pop()
                for size in filling:
                    left[size] += n
                waste, made = waste - n * (most - sum(filling)), made - n
            if open_choices[-1]:
                filling = open_choices[-1].pop()
                n = min(left[size] // filling.count(size) for size in set(filling))
                for size in filling:
                    left[size] -= n
                waste, made = waste + n * (most - sum(filling)), made + n
                chosen.append((filling, n))
                break
            open_choices.pop()
        else:
            break
    return best


def _fewest(counts: dict[int, int], most: int) -> int:
    """A number of sequences that no packing can stay below.

    For any ``short``: lengths above ``most - short`` go with none of at least
    ``short``, those above the half go with no other, and the rest needs room.
    """
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[size] for size in sizes.tolist()], np.int64)
    tokens = sizes * number
    best = -(-int(tokens.sum()) // most)
    half = sizes > most // 2
    for short in sizes[~half].tolist():
        alone = sizes > most - short
        middle = half & ~alone
        rest = int(tokens[~half & (sizes >= short)].sum())
        room = int((number * (most - sizes))[middle].sum())
        best = max(best, int(number[half].sum()) + max(0, -(-(rest - room) // most)))
    return best


def _fillings(left: dict[int, int], sizes: list[int], most: int) -> list[Filling]:
    """Undominated fillings around the longest size, least waste first."""
    largest = sizes[-1]
    found: dict[Filling, int] = {}
    budget = FILLING_STEPS

    def extend(filling: Filling, room: int, top: int) -> bool:
        nonlocal budget
        budget -= 1
        at = bisect.bisect_right(sizes, min(room, top)) - 1
        grown = False
        while at >= 0 and budget > 0:
            size = sizes[at]
            if left[size] > filling.count(size):
                grown = True
                if extend((*filling, size), room - size, size):
                    return True
                if len(found) >= 4 * FILLINGS:
                    return False
            at -= 1
        if not grown and not _dominated(filling, room, left, sizes):
            found[filling] = room
            return room == 0 and len(found) >= FILLINGS
        return False

    extend((largest,), most - largest, largest)
    if not found:  # the search was cut off before it came to an end
        filling, room = (largest,), most - largest
        for size in reversed(sizes):
            while size <= room and left[size] > filling.count(size):
                filling, room = (*filling, size), room - size
        found[filling] = room
    return sorted(found, key=lambda f: (found[f], [-size for size in f]))[:FILLINGS]


def _dominated(filling: Filling, room: int, left: dict[int, int], sizes: list[int]) -> bool:
    """Whether a larger size that is left could take the place of one in the filling."""
    for size in set(filling[1:]):
        at = bisect.bisect_right(sizes, min(size + room, filling[0])) - 1
        larger = sizes[at]
        if larger > size and left[larger] > filling.count(larger):
            return True
    return False


def _best_fit(counts: dict[int, int], most: int) -> Plan:
    """Best fit in decreasing order, many equal bins at a time."""
    groups: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(filling: Filling, n: int) -> None:
        room = most - sum(filling)
        if room not in groups or not groups[room]:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((filling, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                many = most // size
                if left >= many:
                    put((size,) * many, left // many)
                    left %= many
                if left:
                    put((size,) * left, 1)
                break
            room = rooms[at]
            filling, n = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            each = min(room // size, left)
            many = min(n, left // each)
            put(filling + (size,) * each, many)
            if n > many:
                put(filling, n - many)
            left -= each * many
    return [one for group in groups.values() for one in group]


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length: first numbers of runs, their sequences and their offsets."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, n in plan:
        offset = 0
        for size in filling:
            runs.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return {size: tuple(np.array(column) for column in zip(*rows)) for size, rows in runs.items()}


def _look_up(batches: Iterator[pa.RecordBatch], places: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        numbers = batch.column("number").to_numpy()
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        values, begins = np.unique(sizes[order], return_index=True)
        for size, rows in zip(values.tolist(), np.split(order, begins[1:])):
            first, sequences, offsets = places[size]
            run = np.searchsorted(first, numbers[rows], side="right") - 1
            sequence[rows] = sequences[run] + numbers[rows] - first[run]
            offset[rows] = offsets[run]
        yield pa.record_batch(
            [batch.column("own"), pa.array(sequence), pa.array(offset)],
            ["own", "sequence_id", "offset"],
        )


def _pieces(
    batches: Iterator[pa.RecordBatch], tokenizer: str, most: int, end: int
) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    for batch in batches:
        for block in text_blocks(batch.column("text"), BLOCK_BYTES):
            ids, sizes = with_end(*encode.encode(block), end)
            ids = ids.astype("<u4")
            many = -(-sizes // most)
            rows = np.repeat(np.arange(len(sizes)), many)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            short = (sizes - (many - 1) * most)[rows]
            start = np.where(number == 0, 0, short + (number - 1) * most)
            length = np.where(number == 0, short, most)
            at = (np.cumsum(sizes) - sizes)[rows] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(block.low, block.high - block.low).take(pa.array(rows)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
    encode.forget()
