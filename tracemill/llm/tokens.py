"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE cuts a text into pieces before it merges, and it always cuts
between a character that is no white space and white space after it, and between a
letter and punctuation after it that is no apostrophe. The same
stretches between such places come again and again, so a block's stretches are
dictionary-encoded, only new ones go through the tokenizer, and the ids of a text
are those of its stretches in order. A tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from tracemill.llm.arrow_text import SPACED, Block, give_back, ragged
from tracemill.llm.remembered import Remembered

_SPACES = " \t\n\x0b\x0c\r"

# Letters and punctuation of ASCII; an apostrophe may be cut elsewhere.
_LETTERS = np.array([65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])
_MARKS = np.array([33 <= i <= 126 and not chr(i).isalnum() and i != 39 for i in range(256)])

# Bytes of stretches and ids that one Python worker remembers while a task runs, and
# how many it keeps between tasks, when other operators need the room.
REMEMBERED = 48 << 20
KEPT = 8 << 20

# Stretches that the library gets at once: what it makes of a text takes much room.
CALL = 20_000


class _Known(Remembered):
    """Ids of stretches that were encoded before."""

    def __init__(self) -> None:
        super().__init__(REMEMBERED)


class Encoder:
    """Encodes blocks of texts with the tokenizer in a file."""

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self.size = max(self._tokenizer.get_vocab().values()) + 1
        with open(path) as file:
            plan = json.load(file)
        before = plan.get("pre_tokenizer") or {}
        self._stretches = (
            plan["model"]["type"] == "BPE"
            and not plan.get("normalizer")
            and not plan["model"].get("ignore_merges")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") for t in plan.get("added_tokens", ()))
        )
        self._known = _Known()
        if self._stretches:  # in a byte-level vocabulary, a character stands for a byte
            words = self._tokenizer.get_vocab(with_added_tokens=False)
            self._bytes = np.zeros(self.size, np.int64)
            self._bytes[list(words.values())] = [len(word) for word in words]
            # Not before marks that follow a letter in a special token.
            self._marks = _MARKS.copy()
            for number, token in self._tokenizer.get_added_tokens_decoder().items():
                self._bytes[number] = len(token.content.encode())
                for before, mark in zip(token.content, token.content[1:]):
                    if before.isalpha() and mark.isascii():
                        self._marks[ord(mark)] = False

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block in order, and how many each row has."""
        rows = block.high - block.low
        if not len(block.data):
            return np.empty(0, np.uint32), np.zeros(rows, np.int64)
        if not self._stretches:
            found = self._call([block.text(row).decode() for row in range(rows)])
            return (
                np.array([i for ids in found for i in ids], np.uint32),
                np.fromiter(map(len, found), np.int64, rows),
            )
        return self._known.ids(block, _stretch_begins(block, self._marks), self._new)

    def forget(self) -> None:
        """Drop all but the most common of what is remembered, and give the memory back."""
        self._known.shrink(KEPT)
        give_back()

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some stretches in order, and how many each has."""
        # Stretches that begin with white space and end without it can follow one
        # another in one call: the cuts between them stay. A token's length in
        # bytes then tells which stretch it belongs to.
        follows = np.array([text[0] in _SPACES and not text[-1].isspace() for text in texts], bool)
        joined = [texts[i] for i in np.flatnonzero(follows).tolist()]
        found = [self._joined(joined[at : at + CALL]) for at in range(0, len(joined), CALL)]
        ids = np.concatenate([np.empty(0, np.uint32), *(ids for ids, _ in found)])
        counts = np.empty(len(texts), np.int64)
        counts[follows] = np.concatenate([np.empty(0, np.int64), *(sizes for _, sizes in found)])
        if follows.all():
            return ids, counts
        found = self._call([texts[i] for i in np.flatnonzero(~follows).tolist()])
        counts[~follows] = np.fromiter(map(len, found), np.int64, len(found))
        # Put side by side, then in the order of the texts.
        flat = np.concatenate([ids, np.array([i for one in found for i in one], np.uint32)])
        begins = np.empty(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(follows), np.flatnonzero(~follows)])
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(begins, counts)], counts

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that follow one another in a single call."""
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not whole.isascii():
            sizes = np.fromiter((len(text.encode()) for text in texts), np.int64, len(texts))
        ids = np.array(self._call([whole])[0], np.uint32)
        ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _call(self, texts: list[str]) -> list[list[int]]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [one.ids for one in found]


def _stretch_begins(block: Block, marks: np.ndarray) -> np.ndarray:
    """Row starts, white space after what surely is none, and marks after letters."""
    data, starts = block.data, block.starts
    solid = SPACED[data]
    cuts = np.zeros(len(data), bool)
    cuts[1:] = ~solid[1:] & solid[:-1]
    if len(data) > 2:
        # The last bytes of white space outside ASCII: no cut after these.
        odd = np.flatnonzero(cuts[2:] & (data[1:-1] >= 0x80)) + 2
        lead, last = data[odd - 2], data[odd - 1]
        cuts[odd[((lead == 0xC2) | ((lead >= 0x80) & (lead < 0xC0))) & (last < 0xB0)]] = False
    cuts[1:] |= marks[data[1:]] & _LETTERS[data[:-1]]
    cuts[starts[:-1][starts[:-1] < len(data)]] = True
    return np.flatnonzero(cuts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a worker."""
    return Encoder(path)
