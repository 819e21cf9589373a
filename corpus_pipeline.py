"""A training corpus from raw documents: five stages, each stored and read again.

Every stage but the last returns the columns of ``documents``; what a stage removes
is gone for the next. Nulls, empty texts and empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.line_dedup import dedup_lines
from tracemill.llm.near_dedup import near_duplicates
from tracemill.llm.packing import pack, pieces
from tracemill.llm.queries import TOKENIZER
from tracemill.llm.stored import bounded, stored
from tracemill.llm.toxicity import toxicity_scores


# A number of every row: ids may be null or repeated.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """Stored rows, each with a number of its own."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose number is not in ``gone``, without the number."""
    rows = stored(gone.select(F.col(ROW).alias("__gone")), "gone")
    left = numbered.join(bounded(rows, 16), numbered[ROW] == F.col("__gone"), "left_anti")
    return left.drop(ROW)


def remove_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    docs = _numbered(docs)
    scores = toxicity_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"), row=ROW)
    return _without(docs, scores.where("predicted = 1"))


def remove_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without repeated lines; a document that loses all of them stays, empty."""
    found = dedup_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", length)
    return found


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of every group of near copies, the first of those with the smallest id.

    A row without an id stays only where no row of its group has one.
    """
    docs = _numbered(docs)
    # Ordered by id, nulls last, and never the same for two rows.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    found = near_duplicates(docs.select(key.alias("key"), "text"), "key")
    return _without(docs, found.where("not kept").select(f"key.{ROW}"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = _numbered(docs)
    return _without(docs, decontaminate(docs, items, ROW).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(pieces(docs, TOKENIZER))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack_sequences),
]

# A trained classifier and a tokenizer have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
