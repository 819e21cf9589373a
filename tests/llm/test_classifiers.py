"""Classifiers on rows they did not learn from, and on planted cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import EDGES, SCHEMA, frame
from pyspark.sql import functions as F

from tracemill.llm.quality_fm import LEVELS, WORD_BITS, Machine, quality_scores
from tracemill.llm.queries import op3_quality, op9_toxicity
from tracemill.llm.toxicity import toxicity_scores

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label", [(op3_quality, "quality"), (op9_toxicity, "toxic")])
def test_held_out_rows(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = query(spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(key).encode()) % 5 == 0 for key in rows.doc_id)
    right = rows.predicted == rows[label]
    assert len(rows) > 500 and right.mean() > 0.97
    for value in (0, 1):
        assert right[rows[label] == value].mean() > 0.85


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    for scores, name in ((quality_scores, "quality"), (toxicity_scores, "toxic")):
        other = labels.withColumn(name, F.when(out, 1 - F.col(name)).otherwise(F.col(name)))
        one, two = (scores(docs, x).orderBy("doc_id").collect() for x in (labels, other))
        assert one == two


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_edge_cases(spark, scores):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 1, 0), (6, 0, 1), (6, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    docs = frame(spark, EDGES)
    rows = scores(docs, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    twice = [r.score for r in rows if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert scores(docs, labels.limit(0)).count() == len(EDGES)
    assert scores(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_pairs_by_the_identity_of_squares():
    """The linear-time sum equals the sum over all pairs."""
    random = np.random.default_rng(1)
    inputs = (1 << WORD_BITS) + 2 * LEVELS
    machine = Machine(
        np.sort(random.random((2, LEVELS - 1)), axis=1),
        0.3,
        random.normal(size=inputs),
        random.normal(0, 0.2, (inputs, 8)),
    )
    words, values = random.integers(0, 1 << WORD_BITS, 7), random.random(7)
    shape = random.random((2, 2))
    found = machine.scores(words, values, np.array([4, 3]), shape)
    for row, (a, b) in enumerate(((0, 4), (4, 7))):
        own = [*words[a:b], *machine.levels(shape)[row]]
        x = [*np.float32(values[a:b]), 0.5, 0.5]
        total = 0.3 + sum(machine.weights[i] * v for i, v in zip(own, x))
        for i in range(len(own)):
            for j in range(i):
                total += machine.factors[own[i]] @ machine.factors[own[j]] * x[i] * x[j]
        assert found[row] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-4)


def test_neutral_mentions_of_groups_are_not_toxic(spark):
    """A group that stands mostly in toxic training texts is not toxic by itself."""
    rows, labels = [], []
    for i in range(900):
        toxic, group = i % 3 == 0, ("muslims" if i % 3 == 0 else ("women", "teachers")[i % 2])
        insult = "idiots" if toxic and i % 2 else "fools" if toxic else "people"
        rows.append((i, f"the {group} next door are {insult} number{i} today"))
        labels.append((i, int(toxic)))
    probes = ["the muslims next door are people", "the women are idiots"]
    probes += ["the muslims cook today", "the women cook today", "the refugees cook today"]
    rows += [(2000 + i, text) for i, text in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")

    def scores(penalty):
        found = toxicity_scores(docs, known, swap_penalty=penalty).where("doc_id >= 2000")
        return [r.score for r in found.orderBy("doc_id").collect()]

    plain, fair = scores(0.0), scores(50.0)
    assert max(plain[2:]) - min(plain[2:]) > 0.5 and max(fair[2:]) - min(fair[2:]) < 0.02
    assert fair[2] < plain[2] and fair[0] < 0.5 < fair[1]


def test_hashes_do_not_depend_on_the_block():
    from tracemill.llm.arrow_text import find_words, hash_words, text_blocks

    texts = pa.array(["Ein Wort", None, "", "y" * 5_000_000 + " kurz", "Ein  Wort\n"])
    seen = []
    for size in (10, 1 << 20, 1 << 30):
        found = []
        for block in text_blocks(texts, size):
            found += hash_words(block, find_words(block)).tolist()
        seen.append(found)
    assert seen[0] == seen[1] == seen[2] and seen[0][:2] == seen[0][-2:]
