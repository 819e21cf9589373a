"""Files whose names Spark hides: listed level by level in tasks, and read there.

Spark's own listing leaves out names that begin with ``_`` or ``.``, also where such a
file is named itself. Here every task lists some folders, one job for each level of the
tree, so nothing walks it on the driver. Hidden parquet files are read by row group and
hidden csv files one by one, both in tasks, through the stores that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.roles import SUPPORTED_SUFFIXES
from tracemill.session import durable, rows_frame
from tracemill.sources.catalogue import file_catalogue, group_schema, layout_groups
from tracemill.sources.runs import FILE_SCHEMA, qualified, run_key

_ENTRY = "path string, folder boolean, hidden boolean, length bigint, modified timestamp_ntz"
# Folders that one task lists, and rows of a batch that it hands on.
FOLDERS_PER_TASK = 32
BATCH_ROWS = 10_000


def _store_reader():
    """Function that opens the store of a path; workers need not have this package."""

    def opened(path):
        from pyarrow import fs

        plain = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        return fs.FileSystem.from_uri(plain.replace("s3a://", "s3://", 1))

    return opened


def _lister():
    opened = _store_reader()
    fields = [field.split(" ")[0] for field in _ENTRY.split(", ")]

    def entries(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for folder, hidden in zip(batch["path"], batch["hidden"]):
                store, inner = opened(folder)
                for found in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                    if found.type in (fs.FileType.File, fs.FileType.Directory):
                        path = f"{folder.rstrip('/')}/{found.base_name}"
                        here = bool(hidden) or found.base_name[0] in "_."
                        time = found.mtime and found.mtime.replace(tzinfo=None)
                        inside = found.type == fs.FileType.Directory
                        rows.append((path, inside, here, found.size or 0, time))
            yield pd.DataFrame(rows, columns=fields).astype({"modified": "datetime64[us]"})

    return entries


def list_tree(
    spark: SparkSession, folders: Sequence[str], root: str, shared: tuple[str, str] | None = None
) -> DataFrame:
    """All parquet and csv files below the folders, hidden ones too, as ``files_in`` has them.

    Also ``hidden``: a part of the path below the folder begins with ``_`` or ``.``. One
    job for each level of the deepest folder.
    """
    level = rows_frame(spark, [(qualified(spark, f), False) for f in folders], "path string, hidden boolean")
    count, found = len(folders), None
    while count:
        dealt = level.repartition(1 + count // FOLDERS_PER_TASK)
        seen = durable(dealt.mapInPandas(_lister(), _ENTRY))
        files = seen.where("not folder")
        found = files if found is None else found.unionByName(files)
        level = seen.where("folder").select("path", "hidden")
        count = level.count()
    if found is None:
        return rows_frame(spark, [], FILE_SCHEMA).withColumn("hidden", F.lit(False))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (
        found.withColumn("suffix", suffix)
        .where(F.col("suffix").isin(*SUPPORTED_SUFFIXES))
        .select(
            "path",
            run_key(F.col("path"), qualified(spark, root), shared).alias("run"),
            "suffix",
            "length",
            "modified",
            "hidden",
        )
    )


def hidden_frames(spark: SparkSession, files: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of the files (``path``, ``suffix``), parquet and csv, as the other readers give them.

    Parquet columns must be plain: lists and structures are refused.
    """
    known = file_catalogue(files)
    typed, texts = [], []
    rows = known.where("suffix = '.parquet'").select("types").distinct().collect()
    layouts = {tuple((n, k) for n, k in json.loads(row["types"])): row["types"] for row in rows}
    for members in layout_groups(list(layouts)):
        schema = group_schema(members)
        if schema is None:
            raise ValueError("hidden files with nested columns are not read")
        own = rows_frame(spark, [(layouts[types],) for types in members], "types string")
        paths = known.join(F.broadcast(own), "types").select("path")
        typed.append(_with_metadata(_parquet_rows(paths, schema)))
    headers = known.where("suffix = '.csv'").select("layout").distinct().orderBy("layout").collect()
    for row in headers:
        paths = known.where((F.col("suffix") == ".csv") & (F.col("layout") == row["layout"])).select("path")
        texts.append(_with_metadata(_csv_rows(paths, row["layout"])))
    return typed, texts


_PATH = "__file_path"


def _with_metadata(df: DataFrame) -> DataFrame:
    """The path where Spark's own readers have it."""
    path = F.regexp_replace(_PATH, "^file:/+", "file:///")
    path = F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return df.withColumn("_metadata", F.struct(path.alias("file_path"))).drop(_PATH)


def _parquet_rows(paths: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of parquet files, dealt to tasks by row group."""
    opened = _store_reader()
    wide = T.StructType([*schema.fields, T.StructField(_PATH, T.StringType())])
    target = to_arrow_schema(wide)

    def groups(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"]:
                store, inner = opened(path)
                with store.open_input_file(inner) as handle:
                    rows += [(path, i) for i in range(pq.read_metadata(handle).num_row_groups)]
            yield pd.DataFrame(rows, columns=["path", "part"]).astype({"part": "int64"})

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = opened(path)
                with store.open_input_file(inner) as handle:
                    file = pq.ParquetFile(handle)
                    for found in file.iter_batches(BATCH_ROWS, row_groups=[part]):
                        size = found.num_rows
                        columns = []
                        for field in target:
                            if field.name == _PATH:
                                columns.append(pa.array([path] * size, pa.string()))
                            elif field.name in found.schema.names:
                                columns.append(found.column(field.name).cast(field.type, safe=False))
                            else:
                                columns.append(pa.nulls(size, field.type))
                        yield pa.RecordBatch.from_arrays(columns, schema=target)

    dealt = durable(paths.mapInPandas(groups, "path string, part bigint"))
    return dealt.repartition(max(1, min(dealt.count(), 10_000))).mapInArrow(read, wide)


def _csv_rows(paths: DataFrame, header: str) -> DataFrame:
    """Rows of csv files of one header as texts; empty values are null."""
    import csv as library

    names: list[str] = []
    for place, name in enumerate(next(library.reader([header]))):
        names.append(name if name and name not in names else f"{name}_{place}")
    wide = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _PATH]])
    opened = _store_reader()

    def read(batches):
        import csv
        import io
        import itertools

        import pyarrow as pa

        kinds = pa.schema([(field, pa.string()) for field in [*names, _PATH]])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = opened(path)
                with store.open_input_stream(inner) as handle:
                    lines = io.TextIOWrapper(handle, "utf-8-sig", errors="replace", newline="")
                    rows = csv.reader(lines)
                    next(rows, None)
                    while some := list(itertools.islice(rows, BATCH_ROWS)):
                        some = [row for row in some if row]
                        columns = [[(row[i] or None) if i < len(row) else None for row in some] for i in range(len(names))]
                        columns.append([path] * len(some))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=kinds)

    return paths.repartition(max(1, min(paths.count(), 10_000))).mapInArrow(read, wide)

