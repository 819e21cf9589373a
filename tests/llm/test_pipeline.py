"""The pipeline against plain Python, stage by stage, and on odd tables."""

from collections import defaultdict

import corpus_pipeline
from helpers import EDGES, SCHEMA, components, contaminated, dedup_lines, frame, near_links
from pyspark.sql import functions as F
from test_tokens import crc, expected, fits

from tracemill.llm.stored import stored
from tracemill.llm.toxicity import toxicity_scores

FOLDER = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    scores = toxicity_scores(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rejected = {r.doc_id for r in scores.where("predicted = 1").collect()}
    wanted = {key: text for key, text in texts(docs).items() if key not in rejected}
    docs = stage("toxicity")(spark, docs, FOLDER)
    assert rejected and texts(docs) == wanted

    plain = dedup_lines([*wanted.items()])
    wanted = {key: kept for key, (kept, _, _) in zip(wanted, plain)}
    docs = stage("line_dedup")(spark, docs, FOLDER)
    assert texts(docs) == wanted and sum(lost for _, _, lost in plain) > 0
    assert {r.doc_id: r.n_chars for r in docs.collect()} == {k: len(t) for k, t in wanted.items()}

    _, links = near_links(wanted)
    named = components(wanted, links)
    wanted = {key: text for key, text in wanted.items() if named[key] == key}
    docs = stage("near_dedup")(spark, docs, FOLDER)
    assert links and texts(docs) == wanted

    clean = {key: text for key, text in wanted.items() if not contaminated(text, items)[0]}
    docs = stage("decontamination")(spark, docs, FOLDER)
    assert len(clean) < len(wanted) and texts(docs) == clean
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    rows = stage("packing")(spark, docs, FOLDER).collect()
    fits(rows, 2048)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for key, ids in expected([*clean.items()]):
        own = sorted(by_doc.pop(key), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [crc(ids[r.start : r.start + r.length]) for r in own]
        assert sum(r.length for r in own) == len(ids)
    assert not by_doc

    whole = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(
        tuple(r[c] for c in columns) for r in rows
    )


def test_stages_on_odd_tables(spark):
    for rows in (EDGES, []):
        docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        columns = docs.columns
        kept = len(rows)
        for name, apply in corpus_pipeline.STAGES[:-1]:
            docs = stored(apply(spark, docs, FOLDER), name)
            now = docs.count()
            assert now <= kept and set(columns) - set(docs.columns) <= {"n_lines", "n_dropped"}
            kept = now
        packed = corpus_pipeline.pack_sequences(spark, docs, FOLDER)
        assert packed.count() >= kept and (kept > 0) == bool(rows)


def test_stages_remove_rows_not_ids(spark):
    docs = frame(spark, EDGES)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stored(apply(spark, docs, FOLDER), name)
    kept = sorted((str(r.doc_id), str(r.text)[:9]) for r in docs.collect())
    wanted = [(key, text) for key, text, *_ in EDGES if key != 5 and (key, text) != (None, "one")]
    assert kept == sorted((str(key), str(text)[:9]) for key, text in wanted)

    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(key, text) for key in (None, 3) for text in (item, f"clean words {key}", f"others {key}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = stage("decontamination")(spark, docs, FOLDER).collect()
    assert {(r.doc_id, r.text) for r in left} == {row for row in rows if row[1] != item}

    copies = [(3, "the same words"), (3, "the same words"), (None, "the same words"), (3, "unlike")]
    copies += [(None, "copies without an id"), (None, "copies without an id"), (None, None)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    left = stage("near_dedup")(spark, docs, FOLDER).collect()
    wanted = [("3", "the same words"), ("3", "unlike"), ("None", "None"), ("None", "copies without an id")]
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == wanted


def test_toxic_rows_leave_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = stored(toxicity_scores(docs, labels), "scores")
    gone = scores.where("predicted = 1").orderBy("doc_id").first().doc_id
    clean = scores.where("predicted = 0").orderBy("doc_id").first().doc_id
    pair = docs.where(docs.doc_id.isin(gone, clean)).withColumn("doc_id", F.lit(None).cast("long"))
    docs = stored(docs.unionByName(pair), "documents")
    left = stage("toxicity")(spark, docs, FOLDER)
    assert left.where("doc_id is null").count() == 1
    assert left.count() == scores.where("predicted = 0").count() + 1
