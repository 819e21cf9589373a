"""Ids of stretches of text that were encoded before, within a budget of bytes."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from tracemill.llm.arrow_text import Block, ragged

# What a remembered stretch takes beside its text and its ids: text object, number,
# entry of the dictionary, places in the arrays.
_ENTRY_BYTES = 220


class Remembered:
    """Stretches and their ids; beyond the budget, those seldom asked for are dropped."""

    def __init__(self, most_bytes: int) -> None:
        self._most = most_bytes
        self._clear()

    def _clear(self) -> None:
        self._numbers: dict[str, int] = {}
        self._begins = np.zeros(1 << 12, np.int64)
        self._counts = np.zeros(1 << 12, np.int64)
        self._asked = np.zeros(1 << 12, np.uint16)
        self._ids = np.zeros(1 << 14, np.uint32)
        self._used = self._letters = 0

    def __len__(self) -> int:
        return len(self._numbers)

    @property
    def bytes(self) -> int:
        return _ENTRY_BYTES * len(self._numbers) + self._letters + 4 * self._used

    def ids(
        self, block: Block, begins: np.ndarray, encode: Callable
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block that is cut at ``begins``, and how many each row has.

        ``encode`` gives, for texts that are not remembered, all their ids in order and
        how many each has. Equal stretches of a block are looked up once.
        """
        offsets = np.append(begins, len(block.data)).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(
            len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block.data))
        ).dictionary_encode()
        # By way of numpy, which makes the text objects much faster than Arrow's lists.
        distinct = texts.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self._of(distinct, encode)[texts.indices.to_numpy()]
        sizes = self._counts[numbers]
        ids = self._ids[ragged(self._begins[numbers], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(begins, block.starts)])

    def _of(self, texts: list[str], encode: Callable) -> np.ndarray:
        if self.bytes > self._most:
            self.shrink()
        known = self._numbers
        numbers = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        places = np.flatnonzero(numbers < 0)
        if len(places):
            new = [texts[place] for place in places.tolist()]
            ids, sizes = encode(new)
            numbers[places] = self._add(new, ids, sizes)
        self._asked[numbers] += self._asked[numbers] < 60_000
        return numbers

    def _add(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        low, high, total = len(self._numbers), len(self._numbers) + len(texts), len(ids)
        if high > len(self._begins):
            room = high + (high >> 2)
            self._begins, self._counts, self._asked = (
                _grown(x, room) for x in (self._begins, self._counts, self._asked)
            )
        if self._used + total > len(self._ids):
            self._ids = _grown(self._ids, self._used + total + (self._used >> 2))
        self._counts[low:high] = sizes
        self._asked[low:high] = 0
        self._begins[low:high] = self._used + np.cumsum(sizes) - sizes
        self._ids[self._used : self._used + total] = ids
        self._used += total
        self._letters += sum(map(len, texts))
        self._numbers.update(zip(texts, range(low, high)))
        return np.arange(low, high)

    def shrink(self, most_bytes: int | None = None) -> None:
        """Keep those asked for most, up to half of the budget or so many bytes."""
        most = self._most // 2 if most_bytes is None else most_bytes
        if self.bytes <= most:
            return
        count = len(self._numbers)
        texts = list(self._numbers)  # in order of their numbers
        cost = _ENTRY_BYTES + 4 * self._counts[:count] + np.fromiter(map(len, texts), np.int64, count)
        order = np.argsort(-self._asked[:count].astype(np.int64), kind="stable")
        keep = np.sort(order[np.cumsum(cost[order]) <= most])
        begins, counts, asked, ids = self._begins[keep], self._counts[keep], self._asked[keep], self._ids
        self._clear()
        self._add([texts[i] for i in keep.tolist()], ids[ragged(begins, counts)], counts)
        self._asked[: len(keep)] = asked >> 1  # what was common long ago fades
        pa.default_memory_pool().release_unused()


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, values.dtype)
    out[: len(values)] = values
    return out
