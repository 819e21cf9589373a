"""Run folders: ``<root>/<run>/[<data path>/]**/*.{parquet,csv}``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.roles import ROOT_RUN, ROOT_RUN_LABEL, SUPPORTED_SUFFIXES
from tracemill.session import rows_frame

FILE_SCHEMA = "path string, run string, suffix string, length bigint, modified timestamp_ntz"


def any_case(suffix: str) -> str:
    """Glob for files that end with ``suffix`` in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def literal(path: str) -> str:
    """A path for Spark's readers, which otherwise take ``[1]`` as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def as_list(value: str | Sequence[str] | None) -> list[str]:
    """One text, several or none, as a list of non-empty texts."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value] if value else []
    return [str(item) for item in value if item]


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return _hadoop_path(spark, path).getFileSystem(conf)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs = _file_system(spark, path)
    target = _hadoop_path(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute path with its scheme, without a trailing slash."""
    full = _file_system(spark, path).makeQualified(_hadoop_path(spark, path))
    return full.toString().rstrip("/")


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder, none if it is not there."""
    if not is_folder(spark, folder):
        return []
    entries = _file_system(spark, folder).listStatus(_hadoop_path(spark, folder))
    return [entry.getPath().getName() for entry in entries]


def run_names(spark: SparkSession, root: str) -> list[str]:
    """Folders directly under ``root`` that are not hidden, sorted.

    One listing of one folder, made anew on each call, so that runs added
    since the last call appear.
    """
    if not is_folder(spark, root):
        return []
    entries = _file_system(spark, root).listStatus(_hadoop_path(spark, root))
    names = (e.getPath().getName() for e in entries if e.isDirectory())
    return sorted(name for name in names if not name.startswith("."))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs below ``root`` as column ``run``; runs without files included."""
    return rows_frame(spark, [(name,) for name in run_names(spark, root)], "run string")


def run_options(runs: DataFrame) -> DataFrame:
    """Distinct ``run`` values with the ``label`` shown for them."""
    label = F.when(F.col("run") == ROOT_RUN, ROOT_RUN_LABEL).otherwise(F.col("run"))
    return runs.select("run", label.alias("label")).distinct()


def data_folder(root: str, run: str, data_path: str | None) -> str:
    """Folder of a run's files: the run folder, or ``data_path`` inside it."""
    inner = (data_path or "").strip()
    base = f"{root.rstrip('/')}/{run}"
    if inner in ("", ".", "./"):
        return base
    return inner if is_absolute(inner) else f"{base}/{inner.rstrip('/')}"


def data_depth(data_path: str | None) -> int:
    """How many levels below the root the data folders of runs are."""
    inner = (data_path or "").strip()
    return 1 + len([part for part in inner.split("/") if part not in ("", ".")])


def is_absolute(path: str) -> bool:
    """Whether a path begins at the top of a store, with or without its scheme."""
    return re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*:)?/", path) is not None


def run_folders(
    spark: SparkSession,
    root: str,
    runs: str | Sequence[str] | None = None,
    data_path: str | None = None,
) -> list[str]:
    """Existing data folders of the chosen runs (of all runs when ``None``)."""
    names = run_names(spark, root)
    if runs is not None:
        chosen = set(as_list(runs))
        names = [name for name in names if name in chosen]
    shared = shared_folder(spark, root, data_path)
    if shared:
        return [shared[0]] if names and is_folder(spark, shared[0]) else []
    # One listing of the pattern, however many runs there are.
    pattern = data_folder(literal(root), "*", data_path and literal(data_path))
    found = _file_system(spark, root).globStatus(_hadoop_path(spark, pattern)) or ()
    present = {entry.getPath().toString() for entry in found if entry.isDirectory()}
    folders = (data_folder(root, name, data_path) for name in names)
    return [folder for folder in folders if qualified(spark, folder) in present]


def shared_folder(
    spark: SparkSession, root: str, data_path: str | None
) -> tuple[str, str] | None:
    """The folder of an absolute data path, and the run that its files belong to.

    All runs have that one data folder; a file there is of the first of them.
    """
    inner = (data_path or "").strip()
    names = run_names(spark, root) if is_absolute(inner) else []
    return (qualified(spark, inner), names[0]) if names else None


def _below(folder: str) -> str:
    """Pattern of paths below a folder, with the next part of the path as its group."""
    scheme, _, inside = folder.rpartition(":")
    if scheme in ("", "file"):
        start = r"^(?:file:)?/*\Q" + inside.lstrip("/").rstrip("/")
    else:
        start = r"^\Q" + folder.rstrip("/")
    return start + r"\E/([^/]+)"


def run_key(path: Column, root: str, shared: tuple[str, str] | None = None) -> Column:
    """Name of the folder directly under ``root`` that holds ``path``, else ``.``.

    A key of the form ``@.../runs/<run>/...`` names its run itself, and files of a
    ``shared_folder`` are of its run. The result depends on the path only, so a
    filter on it prunes files before reading.
    """
    found = F.when(
        path.startswith("@"), F.regexp_extract(path, "/runs/([^/]+)", 1)
    ).otherwise(F.regexp_extract(path, _below(root) + "/", 1))
    found = F.when(found == "", F.lit(ROOT_RUN)).otherwise(found)
    if shared is None:
        return found
    return F.when(path.rlike(_below(shared[0])), F.lit(shared[1])).otherwise(found)


def source_path(file_path: Column) -> Column:
    """``_metadata.file_path`` as the path it stands for, without URL escapes."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def discover_files(
    spark: SparkSession,
    root: str,
    runs: str | Sequence[str] | None = None,
    data_path: str | None = None,
    hidden: bool = False,
) -> DataFrame:
    """All parquet and csv files of the chosen runs, at any depth.

    Only file status is read. Spark skips names that begin with ``_`` or ``.``; with
    ``hidden`` these are listed, too, by tasks that share the folders out.
    """
    folders = run_folders(spark, root, runs, data_path)
    shared = shared_folder(spark, root, data_path)
    if not hidden:
        return files_in(spark, folders, root, shared)
    from tracemill.sources.hidden import list_tree

    return list_tree(spark, folders, root, shared).drop("hidden")


def skipped_files(
    spark: SparkSession,
    root: str,
    runs: str | Sequence[str] | None = None,
    data_path: str | None = None,
) -> DataFrame:
    """Parquet and csv files that loading leaves out unless it is asked for them.

    Column ``path``: a part of it below the run's data folder begins with ``_`` or ``.``.
    """
    from tracemill.sources.hidden import list_tree

    folders = run_folders(spark, root, runs, data_path)
    found = list_tree(spark, folders, root, shared_folder(spark, root, data_path))
    return found.where("hidden").select("path")


def files_in(
    spark: SparkSession, folders: Sequence[str], root: str, shared: tuple[str, str] | None = None
) -> DataFrame:
    """All parquet and csv files below the folders."""
    if not folders:
        return rows_frame(spark, [], FILE_SCHEMA)
    glob = "{" + ",".join(map(any_case, SUPPORTED_SUFFIXES)) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load([literal(folder) for folder in folders])
    )
    return files.select(
        "path",
        run_key(F.col("path"), qualified(spark, root), shared).alias("run"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"),
        "length",
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
    )


def files_of_runs(files: DataFrame, runs: str | Sequence[str] | None) -> DataFrame:
    """Keep the files of the given runs; all files when ``runs`` is ``None``."""
    return files if runs is None else files.where(F.col("run").isin(as_list(runs)))
