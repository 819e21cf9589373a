"""Token ids of a corpus in flat binary files, with 64-bit document offsets.

Every part of the corpus, in ascending order of the ids, is three flat files of
little-endian numbers that can be mapped into memory:

* ``<name>.bin``: token ids, 16-bit where the vocabulary allows it, else 32-bit;
* ``<name>.idx``: 64-bit offsets, one more than there are documents, from 0;
* ``<name>.ids``: 64-bit document ids.

A manifest has a row for every part, with its ``base``: the ids in all parts
before it, a prefix sum over the parts. A task writes under a name of its own and
the manifest holds the names of those tasks that ended well, so a task that is
lost or run twice does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.arrow_text import text_blocks
from tracemill.llm.stored import texts_of
from tracemill.llm.tokens import encoder
from tracemill.session import scratch_path
from tracemill.sources.runs import qualified

BLOCK_BYTES = 4 << 20
NO_ID = -(1 << 63)
_PARTS = "part int, name string, wide boolean, documents long, tokens long"


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block with the end id after every document."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int = 0,
    wide: bool = False,
) -> DataFrame:
    """Write the ids of all documents below ``folder``; returns the manifest.

    ``folder`` is an address that all executors reach; without a scheme it is of the
    session's default store. Documents are dealt by ranges of their ids and sorted in
    each part. Equal ids, or many without one, are dealt by their places in the table, so
    they may fill several parts; all of them are written. A null id comes first and is written as the smallest
    64-bit number. A null text is empty: its document has the end id alone.
    ``wide`` asks for 32-bit ids also where 16 bits would do. The manifest is
    written too, as Parquet, at ``<folder>/manifest``.
    """
    spark = docs.sparkSession
    folder = address(spark, folder)
    place = F.monotonically_increasing_id().alias("place")
    ordered = (
        texts_of(docs, F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), place)
        .repartitionByRange("id", "place")
        .sortWithinPartitions("id", "place")
    )
    path = f"{folder.rstrip('/')}/manifest"
    ordered.mapInArrow(
        lambda batches: _write_part(batches, tokenizer, folder, end, wide), _PARTS
    ).write.parquet(path)
    return read_manifest(spark, folder)


def address(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as Arrow takes it."""
    full = qualified(spark, folder)
    return f"file:///{full[5:].lstrip('/')}" if full.startswith("file:") else full


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a written corpus with their bases; one row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold, one row per document.

    ``doc_id``; ``start``, the number of ids of all documents before it;
    ``n_tokens``, with the end id; ``ids_crc32``, the checksum of its ids as 32-bit
    little-endian numbers. A corpus without documents gives no row.
    """
    folder = address(spark, folder)
    manifest = read_manifest(spark, folder)
    return manifest.select("name", "wide", "base").repartition("name").mapInArrow(
        lambda batches: _read_parts(batches, folder),
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def tokenize(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0
) -> DataFrame:
    """Write to the session's shared folder and read back; see ``read_tokens``."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, folder, doc_id, text, end)
    return read_tokens(docs.sparkSession, folder)


def _write_part(
    batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end: int, wide: bool
) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    wide = wide or encode.size > 1 << 16
    context = TaskContext.get()
    part = context.partitionId()
    name = f"part-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    store, root = pafs.FileSystem.from_uri(folder)
    files = None
    documents = tokens = 0
    for batch in batches:
        if files is None:
            store.create_dir(root, recursive=True)
            files = [store.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "idx", "ids")]
            files[1].write(np.zeros(1, "<u8").tobytes())
        numbers = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for block in text_blocks(batch.column("text"), BLOCK_BYTES):
            ids, counts = with_end(*encode.encode(block), end)
            files[0].write(ids.astype("<u4" if wide else "<u2").tobytes())
            files[1].write((tokens + np.cumsum(counts)).astype("<u8").tobytes())
            files[2].write(numbers[block.low : block.high].astype("<i8").tobytes())
            documents, tokens = documents + len(counts), tokens + len(ids)
    encode.forget()
    if files is not None:
        for file in files:
            file.close()
        row = {"part": part, "name": name, "wide": wide, "documents": documents, "tokens": tokens}
        yield pa.RecordBatch.from_pylist(
            [row],
            pa.schema(
                [
                    ("part", pa.int32()),
                    ("name", pa.string()),
                    ("wide", pa.bool_()),
                    ("documents", pa.int64()),
                    ("tokens", pa.int64()),
                ]
            ),
        )


def _mapped(store: pafs.FileSystem, path: str) -> pa.NativeFile:
    """A file for reading anywhere in it; in memory's address space where it is local."""
    if isinstance(store, pafs.LocalFileSystem):
        return pa.memory_map(path)
    return store.open_input_file(path)


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for part in batch.to_pylist():
            path = f"{root}/{part['name']}"
            offsets = np.frombuffer(_mapped(store, f"{path}.idx").read_buffer(), "<u8")
            numbers = np.frombuffer(_mapped(store, f"{path}.ids").read_buffer(), "<i8")
            kind = np.dtype("<u4" if part["wide"] else "<u2")
            offsets = offsets.astype(np.int64)
            with _mapped(store, f"{path}.bin") as file:
                low = 0
                while low < len(numbers):
                    high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, "right")) - 1
                    high = min(max(high, low + 1), len(numbers))
                    file.seek(int(offsets[low]) * kind.itemsize)
                    size = int(offsets[high] - offsets[low]) * kind.itemsize
                    ids = np.frombuffer(file.read_buffer(size), kind)
                    cuts = offsets[low : high + 1]
                    ids, at = ids.astype("<u4"), (cuts - cuts[0]).tolist()
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
                    own = numbers[low:high]
                    yield pa.record_batch(
                        [
                            pa.array(own, mask=own == NO_ID),
                            pa.array(part["base"] + cuts[:-1]),
                            pa.array(np.diff(cuts)),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    low = high
