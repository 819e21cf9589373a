"""Words of Arrow text columns and their hashes, computed over whole blocks.

Everything here works inside one task on a block of rows: the UTF-8 bytes of a
block are looked at once, with numpy, and no Python object is made per word.
A block holds about ``BLOCK_BYTES``; a longer text is a block of its own, and its
words are hashed piece by piece, so that a piece's work arrays stay bounded.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = (1 << 20) - 64
MASK = (1 << 64) - 1

_WORD_BASE = 0xD6E8FEB86659FD93
_BYTE_CODES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
WINDOW_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


# Which bytes belong to words, and which case is folded.
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACED = ~_table(_SPACES)
ALNUM = np.array([48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    room = 1 << max(16, (size - 1).bit_length())
    return _powers(base, room)[:size], _powers(pow(base, -1, 1 << 64), room)[:size]


@dataclass
class Block:
    """Some rows of a batch: their bytes and where each row begins."""

    low: int
    high: int
    data: np.ndarray
    starts: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.starts[row] : self.starts[row + 1]].tobytes()


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a text column in blocks of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    rows = len(column)
    if not rows:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + rows + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        first = offsets[low]
        yield Block(low, high, raw[first : offsets[high]], offsets[low : high + 1] - first)
        low = high


@dataclass
class Words:
    """Word spans of a block, and the number of the first word of every row."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(block: Block, letters: np.ndarray = SPACED) -> Words:
    """Longest runs of bytes in ``letters``; no run goes over the end of a row."""
    data, starts = block.data, block.starts
    size = len(data)
    if not size:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(starts), np.int64))
    inside = letters[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < size]
    opens[edge] = inside[edge]
    shuts = inside.copy()
    shuts[:-1] &= ~inside[1:] | opens[1:]
    begin = np.flatnonzero(opens)
    return Words(begin, np.flatnonzero(shuts) + 1, np.searchsorted(begin, starts))


def hash_words(block: Block, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, of its bytes alone."""
    codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
    hashes = np.empty(len(words.begin), np.uint64)
    done = 0
    while done < len(hashes):
        origin = int(words.begin[done])
        stop = int(np.searchsorted(words.end, origin + BLOCK_BYTES, side="right"))
        if stop <= done:  # one word longer than a piece
            word = block.data[origin : words.end[done]]
            word = _LOWER[word] if lower else word
            digest = hashlib.blake2b(word.tobytes(), digest_size=8).digest()
            hashes[done] = int.from_bytes(digest, "little")
            done += 1
            continue
        begin, end = words.begin[done:stop] - origin, words.end[done:stop] - origin
        size = int(end[-1])
        up, down = powers(_WORD_BASE, size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(codes[block.data[origin : origin + size]] * up[:size], out=sums[1:])
        hashes[done:stop] = mixed((sums[end] - sums[begin]) * down[begin])
        done = stop
    return hashes


def hash_windows(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, also of those that go over row ends."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    up, down = powers(WINDOW_BASES[which], len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1])


def window_starts(words: Words, size: int) -> np.ndarray:
    """Numbers of the words that begin a window of ``size`` words inside their row."""
    counts = np.maximum(words.counts - size + 1, 0)
    return ragged(words.first[:-1], counts)


def ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i] + 1, ...``, ``counts[i]`` of them, for every i."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(begin, counts)


def covered(starts: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a run that begins at one of ``starts``."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values, dealt to rows by ``counts``, as an Arrow list column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def give_back() -> None:
    """Hand memory that is free back to the system; an idle worker would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a system without such a call
        pass


def giving_back(task: Callable) -> Callable:
    """A task over batches that hands free memory back when it ends."""

    @wraps(task)
    def run(*args, **options):
        yield from task(*args, **options)
        give_back()

    return run
