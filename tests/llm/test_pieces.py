"""Pieces against the sentencepiece library: random texts, odd ones, whole tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import EDGES, SCHEMA, frame

from tracemill.llm.arrow_text import text_blocks
from tracemill.llm.queries import PIECES, op12_pieces
from tracemill.llm.remembered import Remembered
from tracemill.llm.sentence_pieces import PieceEncoder, decode_pieces, encode_pieces, read_model

FOLDER = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "    ", "▁", "\n", "\t", "\x00", "x", "é", "語", "é", "😀", "1", "22", "....", "ﬁ"]
PARTS += ["<s>", "<unk>", "<0x41>", "　", "\u0085", "\r\n", " the", "ing", "'s", "aaaa", "=="]


@pytest.fixture(scope="module")
def own():
    return PieceEncoder(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(encoder, texts, size=50_000):
    out = []
    for block in text_blocks(pa.array(texts), size):
        ids, counts = encoder.encode(block)
        out += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_random_texts_equal_the_library(own, library):
    pick = random.Random(4)
    pieces = list(own._number)
    texts = [
        "".join(pick.choice(pieces if pick.random() < 0.6 else PARTS) for _ in range(pick.randint(0, 9)))
        for _ in range(20_000)
    ]
    texts += [text.replace("▁", " ") for text in texts[:5000]]
    assert ids_of(own, texts) == library.encode(texts)


def test_runs_equal_the_library(own, library):
    """Runs are where merges could go either way, and where places fail."""
    texts = [part * n for part in ".-=*_#/ a1\\éx▁" for n in (1, 2, 3, 5, 15, 16, 17, 31, 33, 64, 100)]
    texts += [part * n for part in ("ab", "the", "ha ", " .", "aab", "0x", "est") for n in (2, 7, 40)]
    texts += ["x" * 20_000, " " * 5000 + "word" + " " * 3000]
    assert ids_of(own, texts) == library.encode(texts)


def test_neighbours_merge_to_themselves(own):
    """What the method stands on: merging gives the only sequence whose neighbours fit."""
    pick = random.Random(8)
    failed = 0
    for _ in range(3000):
        text = "▁" + "".join(pick.choices("abcdeinorst", k=pick.randint(1, 14)))
        out = []
        own.pieces_of(text, out)
        assert out == own.merged(text)
        assert all(own.merged("".join(own._text[x] for x in pair)) == list(pair) for pair in zip(out, out[1:]))
        first = own._automaton.iter_long(text)
        failed += [number for _, number in first] != out
    assert failed  # the longest pieces alone are not the answer


def test_forgetting_does_not_change_ids(library):
    encoder = PieceEncoder(PIECES)
    encoder._known = Remembered(2000)
    pick = random.Random(6)
    texts = [" ".join(str(pick.randint(0, 300)) for _ in range(20)) for _ in range(300)]
    assert ids_of(encoder, texts, 300) == library.encode(texts)
    assert encoder._known.bytes < 20_000 and len(encoder._known)
    numbers = encoder._known
    common = max(numbers._numbers, key=lambda text: numbers._asked[numbers._numbers[text]])
    numbers.shrink()
    assert common in numbers._numbers and numbers.bytes <= 2000


def test_other_models_are_refused(tmp_path):
    model = read_model(PIECES)
    assert len(model.pieces) == 32_000 and model.before and len(model.bytes_of) == 256
    (tmp_path / "none.model").write_bytes(b"")
    with pytest.raises(ValueError, match="merge type"):
        read_model(str(tmp_path / "none.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    wanted = []
    for row in docs:
        ids = library.encode(row.text or "")
        digest = sha(",".join(map(str, ids)))
        wanted.append((row.doc_id, len(ids), digest, sha(library.decode(ids) if ids else "")))
    assert sorted(map(tuple, op12_pieces(spark, FOLDER).collect())) == sorted(wanted)


def test_edge_cases(spark, library):
    docs = frame(spark, [row for row in EDGES if row[0] != 7] + [(7, "x" * 200_000, "en", "b", 1)])
    rows = encode_pieces(docs, PIECES)
    found = sorted((str(r.doc_id), r.ids) for r in rows.collect())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert found == sorted((str(key), library.encode(text) if text else []) for key, text in texts)
    back = decode_pieces(rows, PIECES)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted(
        (str(key), text or "") for key, text in texts
    )
    odd = spark.createDataFrame([(None, "a"), ([], "b"), ([1, 2, 0, 300], "c")], "ids array<int>, decoded string")
    assert [r.decoded for r in decode_pieces(odd, PIECES).collect()] == [None, "", library.decode([1, 2, 0, 300])]
    none = spark.createDataFrame([], SCHEMA)
    assert decode_pieces(encode_pieces(none, PIECES), PIECES).count() == 0
