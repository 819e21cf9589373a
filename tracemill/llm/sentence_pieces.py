"""Encoding and decoding with a SentencePiece model of merge type, by backtracking.

Merging finds the pieces of a text by joining neighbours, best score first. Without
merging: the pieces are right if every piece and its neighbour, put together and merged
again, come out as they were, and only one sequence of pieces has that. So a text is
read from the left. An Aho-Corasick automaton gives the longest piece at each place; a
piece that does not go with the one before it gives way to the next shorter piece that
it begins with; where none is left, the place is marked in a bitfield as failed, the
piece before is taken back, and no piece is tried again that ends at a marked place.
Every place fails once at most, so the time is linear in the text.

Merges never go over a character that is in no piece, nor between two characters that
no piece has side by side. A text is cut there, as far as these are of ASCII. The same
stretches come again and again; their ids are remembered within a budget of bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import (
    Block,
    giving_back,
    list_array,
    text_blocks,
)
from tracemill.llm.remembered import Remembered
from tracemill.llm.stored import texts_of

# The sign that stands for a blank; kinds of pieces and of models in a
# model file, and the numbers of its fields.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_KIND_OF_MODEL, _BLANK_AFTER, _BYTE_FALLBACK = 3, 24, 35
_CHARSMAP, _BLANK_BEFORE, _FEWER_BLANKS, _ESCAPED = 2, 3, 4, 5

NEVER = float("-inf")

# What one Python worker remembers, and pairs of pieces whose merging it knows.
REMEMBERED_BYTES = 96 << 20
PAIRS = 1 << 20
# A batch of ids handed on is closed beyond so many.
BATCH_IDS = 1 << 20


@dataclass
class Model:
    """What encoding has to know of a model file."""

    pieces: list[tuple[str, float, int]]
    before: bool  # a blank is put before the text
    unknown: int
    bytes_of: dict[int, int]  # byte -> its piece


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a message in a model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> Model:
    """The model in a file; an error if it is none that this module encodes exactly."""
    with open(path, "rb") as file:
        parts = list(_fields(file.read()))
    pieces = []
    for number, own in parts:
        if number == _PIECE:
            found = dict(_fields(own))
            score = struct.unpack("<f", found.get(2, b"\0\0\0\0"))[0]
            pieces.append((found.get(1, b"").decode(), score, found.get(3, NORMAL)))
    trainer = dict(_fields(b"".join(own for number, own in parts if number == _TRAINER)))
    rules = dict(_fields(b"".join(own for number, own in parts if number == _NORMALIZER)))
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(_KIND_OF_MODEL, 1) != MERGES or not trainer.get(_BYTE_FALLBACK, 0):
        raise ValueError("not a model of merge type with a piece for every byte")
    if kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("a model with unused or user-defined pieces")
    if rules.get(_CHARSMAP) or rules.get(_FEWER_BLANKS, 1) or not rules.get(_ESCAPED, 1):
        raise ValueError("a model that changes texts before it encodes them")
    if trainer.get(_BLANK_AFTER, 0):
        raise ValueError("a model with blanks at the ends of words")
    return Model(
        pieces,
        bool(rules.get(_BLANK_BEFORE, 1)),
        next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0),
        {int(piece[1:-1], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE},
    )


class PieceEncoder:
    """Encodes texts with the model in a file."""

    def __init__(self, path: str) -> None:
        model = self.model = read_model(path)
        self._score = [score for _, score, _ in model.pieces]
        self._text = [piece for piece, _, _ in model.pieces]
        self._size = [len(piece) for piece in self._text]
        own = self._number = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self._longest = max(map(len, own), default=1)
        self._automaton = ahocorasick.Automaton()
        for piece, number in own.items():
            self._automaton.add_word(piece, number)
        self._automaton.make_automaton()
        # The longest piece that a piece begins with, other than itself; -1: none.
        self._shorter = [-1] * len(model.pieces)
        for piece, number in own.items():
            cuts = (piece[:size] for size in range(len(piece) - 1, 0, -1))
            self._shorter[number] = next((own[cut] for cut in cuts if cut in own), -1)
        self._letters = frozenset(piece for piece in own if len(piece) == 1)
        known = "".join(map(re.escape, sorted(self._letters)))
        self._runs = re.compile(f"[{known}]+|[^{known}]") if known else re.compile("(?s:.)")
        # By two bytes of a text: whether it is cut between them. A sign for a blank ends
        # with a byte above ASCII, so there is no cut after it.
        self._cut = np.zeros((256, 256), bool)
        self._cut[:128, :128] = True
        for pair in {piece[i : i + 2] for piece in own for i in range(len(piece) - 1)}:
            plain = pair.replace(BLANK, " ")
            if plain.isascii():
                self._cut[ord(plain[0]), ord(plain[1])] = False
        # By a piece (-1: none), the pieces that may or may not follow it.
        self._fits: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        self._known = Remembered(REMEMBERED_BYTES)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block in order, and how many each row has."""
        rows = block.high - block.low
        if not len(block.data):
            return np.empty(0, np.uint32), np.zeros(rows, np.int64)
        begins = block.starts[:-1][np.diff(block.starts) > 0]
        if self.model.before:  # a blank before every text that is not empty
            data = np.insert(block.data, begins, 32)
            block = Block(0, rows, data, block.starts + np.searchsorted(begins, block.starts))
            begins = begins + np.arange(len(begins))
        cuts = np.zeros(len(block.data), bool)
        cuts[1:] = self._cut[block.data[:-1], block.data[1:]]
        cuts[begins] = True
        return self._known.ids(block, np.flatnonzero(cuts), self._encoded)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = []
        letters, backtrack = self._letters, self._backtrack
        for text in texts:
            text = text.replace(" ", BLANK)
            if letters.issuperset(text):
                backtrack(text, ids)
            else:
                self.pieces_of(text, ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def pieces_of(self, text: str, out: list[int]) -> None:
        """Add the ids of a text whose blanks are signs already."""
        for run in self._runs.findall(text):
            if run[0] in self._letters:
                self._backtrack(run, out)
            else:
                out.extend(self.model.bytes_of.get(x, self.model.unknown) for x in run.encode())

    def _backtrack(self, text: str, out: list[int]) -> None:
        size, longest, find = len(text), self._longest, self._automaton.iter_long
        sizes, shorter, fits = self._size, self._shorter, self._fits
        failed = None  # a bit a place, made when the first place fails
        base, place, before = len(out), 0, -1
        row = fits.setdefault(before, {})
        piece = next(find(text[:longest]))[1]
        while True:
            while piece >= 0:
                end = place + sizes[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fit = row.get(piece)
                    if fit is None:
                        fit = self._merges_to(before, piece)
                    if fit:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == size:
                    return
                place, before = end, piece
                row = fits.get(piece)
                if row is None:
                    row = fits[piece] = {}
                piece = next(find(text[place : place + longest]))[1]
            else:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[place >> 3] |= 1 << (place & 7)
                if len(out) == base:
                    raise ValueError("no pieces make up the text")
                taken = out.pop()
                place -= sizes[taken]
                piece = shorter[taken]
                before = out[-1] if len(out) > base else -1
                row = fits[before]

    def _merges_to(self, before: int, piece: int) -> bool:
        """Whether two pieces come out again if their text is merged; ``before`` may be none."""
        row = self._fits.setdefault(before, {})
        fit = row.get(piece)
        if fit is None:
            if self._pairs >= PAIRS:
                for own in self._fits.values():  # rows are held by who reads them
                    own.clear()
                self._pairs = 0
            fit = row[piece] = self._stay_apart(self._text[before] if before >= 0 else "", self._text[piece])
            self._pairs += 1
        return fit

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging two pieces' text makes the pieces, and nothing over their border."""
        number, score = self._number, self._score
        parts, border = list(left + right), len(left)

        def of(i: int) -> float:
            found = number.get(parts[i] + parts[i + 1])
            return NEVER if found is None else score[found]

        scores = [of(i) for i in range(len(parts) - 1)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)  # of equals the leftmost
            if i == border - 1:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < border:
                border -= 1
            if i:
                scores[i - 1] = of(i - 1)
            if i < len(scores):
                scores[i] = of(i)
        return len(parts) == (2 if left else 1)

    def merged(self, text: str) -> list[int]:
        """Pieces of a short text by merging: the best score first, then from the left."""
        parts, number, score = list(text), self._number, self._score
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                found = number.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or score[found] > best):
                    best, where = score[found], i
            if best is None:
                return [number[part] for part in parts]
            parts[where : where + 2] = [parts[where] + parts[where + 1]]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a model file, made once in a worker."""
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the pieces of every whole text, one row per row of ``docs``.

    ``model`` is the path of a model file on every machine; the ids are those that the
    library gives, without marks of begin and end. A null or empty text has no ids.
    Repeated rows and null ids stay as they are; other columns are ignored.
    """
    asked = texts_of(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(partial(_encode, path=model), f"doc_id {kind}, ids array<int>")


@giving_back
def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = piece_encoder(path)
    for batch in batches:
        names, held, low, total = batch.column(0), [], 0, 0

        def made(high: int) -> pa.RecordBatch:
            ids = np.concatenate([ids for ids, _ in held])
            lists = list_array(ids.astype(np.int32), np.concatenate([n for _, n in held]), pa.int32())
            return pa.RecordBatch.from_arrays([names[low:high], lists], ["doc_id", "ids"])

        for block in text_blocks(batch.column(1)):
            held.append(encoder.encode(block))
            total += len(held[-1][0])
            if total > BATCH_IDS:
                yield made(block.high)
                held, low, total = [], block.high, 0
        if held:
            yield made(len(names))


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, what the library's ``decode`` makes of ``ids``.

    Null ids give a null text, no ids an empty one. A column that has the name of the
    text is replaced.
    """
    kept = rows.drop(text)
    schema = kept.withColumn(text, F.lit(None).cast("string")).schema
    where = kept.columns.index(ids)
    return kept.mapInArrow(partial(_decode, path=model, ids=where, text=text), schema)


@giving_back
def _decode(
    batches: Iterable[pa.RecordBatch], path: str, ids: int, text: str
) -> Iterator[pa.RecordBatch]:
    library = _library(path)
    for batch in batches:
        lists = batch.column(ids)
        texts = [None if x is None else library.decode(x) if x else "" for x in _lists(lists)]
        names = [*batch.schema.names, text]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """Rows of a list column as lists, one at a time."""
    for row in range(len(column)):
        value = column[row]
        yield value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else None


def ids_text(ids: Column) -> Column:
    """Ids in decimal, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
