"""Token ids against the library, files against a round trip, packing against its rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES, SCHEMA, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm.arrow_text import text_blocks
from tracemill.llm.packing import _best_fit, _fewest, bin_completion, pack, pieces
from tracemill.llm.queries import TOKENIZER, op2_token_files, op5_pack
from tracemill.llm.token_files import read_manifest, read_tokens, write_tokens
from tracemill.llm.tokens import Encoder, _Known

FOLDER = "/root/testdata/sf0.001"
PARTS = ["a", "é", " ", "  ", "\n", " ", "　", " ", "\u0085", "'s", "'t", "1", "۲", "!"]
PARTS += ["語", "\t", " x", "<|endoftext|>", "​", "😀", "à", "\x1c", "\r\n", "word", " the"]


def expected(rows, end=0):
    """Ids of every (id, text), sorted by id, null first."""
    library = Tokenizer.from_file(TOKENIZER)
    ordered = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    texts = [text or "" for _, text in ordered]
    found = library.encode_batch(texts, add_special_tokens=False)
    return [(key, [*one.ids, end]) for (key, _), one in zip(ordered, found)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("whole", [False, True])
def test_ids_equal_the_library(whole):
    pick = random.Random(5)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 12))) for _ in range(20_000)]
    own, library = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert own._stretches
    own._stretches = not whole
    for block in text_blocks(pa.array(texts), 50_000):
        ids, counts = own.encode(block)
        wanted = library.encode_batch(texts[block.low : block.high], add_special_tokens=False)
        assert counts.tolist() == [len(one.ids) for one in wanted]
        assert ids.tolist() == [i for one in wanted for i in one.ids]


def test_forgetting_does_not_change_ids(monkeypatch):
    texts = ["one two three", "two three four", "", "five one"]
    own = Encoder(TOKENIZER)
    before = [own.encode(block) for block in text_blocks(pa.array(texts))]
    monkeypatch.setattr("tracemill.llm.tokens.REMEMBERED", 2)
    own._known = _Known()
    for block, (ids, counts) in zip(text_blocks(pa.array(texts)), before):
        again = own.encode(block)
        assert (again[0] == ids).all() and (again[1] == counts).all()


def test_files_hold_the_corpus_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted, start = [], 0
    for key, ids in expected([(r.doc_id, r.text) for r in docs.collect()]):
        wanted.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    found = [tuple(r) for r in op2_token_files(spark, FOLDER).orderBy("doc_id").collect()]
    assert found == wanted


def test_files_of_edge_cases(spark, tmp_path):
    docs = frame(spark, EDGES)
    folder = f"file://{tmp_path}/corpus"
    manifest = write_tokens(docs, TOKENIZER, folder, end=7, wide=True)
    wanted = expected([row[:2] for row in EDGES], 7)
    assert manifest.count() == read_manifest(spark, folder).count()
    total = sum(len(ids) for _, ids in wanted)
    assert manifest.groupBy().sum("tokens").first()[0] == total
    found = [tuple(r) for r in read_tokens(spark, folder).collect()]
    assert sorted((str(r[0]), r[3]) for r in found) == sorted((str(k), crc(i)) for k, i in wanted)
    starts = sorted((r[1], r[2]) for r in found)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    ids = sorted(found, key=lambda r: r[1])
    assert [r[0] for r in ids] == [k for k, _ in wanted]


def test_one_id_may_fill_several_parts(spark, tmp_path):
    """A third of all rows are without an id, another third has one id."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id"))
    docs = spark.range(0, 6000, 1, 4).select(ids.alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    folder = str(tmp_path / "hot")
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # parts of a few rows would be united
    spark.conf.set(small, "false")
    try:
        manifest = write_tokens(docs, TOKENIZER, folder).collect()
    finally:
        spark.conf.set(small, "true")
    assert max(part.documents for part in manifest) < 2000 and len(manifest) > 3
    rows = sorted(read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(n) for n in _before([r.n_tokens for r in rows])]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and sum(not known for known, _ in keys) == 2000
    wanted = Counter(crc(ids) for _, ids in expected([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter(r.ids_crc32 for r in rows) == wanted


def _before(counts):
    total = 0
    for count in counts:
        yield (total,)
        total += count


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    write_tokens(docs, TOKENIZER, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert pack(pieces(docs, TOKENIZER)).count() == 0


def fits(rows, most):
    """Sequences are gapless from 0 and within the bound; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= most
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    return len(held)


def test_packed_pieces_are_the_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = op5_pack(spark, FOLDER).collect()
    bins = fits(rows, 2048)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    lengths = []
    for key, ids in expected([(r.doc_id, r.text) for r in docs.collect()]):
        own = sorted(by_doc[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert [r.ids_crc32 for r in own] == [crc(ids[r.start : r.start + r.length]) for r in own]
        lengths += [r.length for r in own]
    assert -(-sum(lengths) // 2048) <= bins <= 1.01 * -(-sum(lengths) // 2048) + 1


def test_packing_of_edge_cases(spark):
    docs = frame(spark, EDGES)
    made = pieces(docs, TOKENIZER)
    packed = pack(made.selectExpr("*", "'x' as offset", "1 as sequence_id"))
    rows = packed.collect()
    assert fits(rows, 2048) and len(rows) == made.count()
    assert sorted(packed.columns) == sorted([*made.columns, "sequence_id", "offset"])
    odd = spark.createDataFrame([(0,), (None,), (5,), (5,)], "length long")
    found = sorted((r["length"] or 0, r["offset"] is None) for r in pack(odd, 8).collect())
    assert found == [(0, True), (0, True), (5, False), (5, False)]
    with pytest.raises(Exception, match="longer than a sequence"):
        pack(spark.createDataFrame([(9,)], "length long"), 8).collect()


def fewest_bins(sizes, most):
    """By trying every place for every piece."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                left = list(rooms)
                left.remove(room)
                put(i + 1, [*left, room - sizes[i]])
        put(i + 1, [*rooms, most - sizes[i]])

    put(0, [])
    return best


def test_search_finds_the_fewest_sequences():
    pick = random.Random(2)
    better = 0
    for _ in range(150):
        sizes = sorted((pick.randint(15, 70) for _ in range(9)), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        plan = bin_completion(counts, 100)
        made = defaultdict(int)
        for filling, n in plan:
            assert sum(filling) <= 100
            for size in filling:
                made[size] += n
        assert dict(made) == counts
        bins = sum(n for _, n in plan)
        assert _fewest(counts, 100) <= fewest_bins(sizes, 100) == bins
        better += bins < sum(n for _, n in _best_fit(counts, 100))
    assert better  # more than best fit alone
