"""Reading of parquet and csv files into one tagged DataFrame.

Files of one run, and of different runs, may differ in columns and types. A catalogue
of their footers and headers is made first, in one job; from it the reads are planned.
Parquet files are one read for each set of types that exclude one another, named by the
highest folders that hold no others. Csv files are one read of texts by position, and
names are given by each file's header. The plan grows with the number of layouts, not of
files.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.time import NTZ
from tracemill.operators.clean import strip_names
from tracemill.operators.joins import lookup_join
from tracemill.operators.profile import datetime_bounds
from tracemill.roles import SUPPORTED_SUFFIXES, Roles, col, quoted
from tracemill.session import durable, rows_frame
from tracemill.sources.catalogue import (
    covers,
    file_catalogue,
    footer_reader,
    group_schema,
    layout_groups,
    time_bounds,
    without_bounds,
)
from tracemill.sources.hidden import hidden_frames, list_tree
from tracemill.sources.quoted import QUOTING, csv_records, plain_path, torn_files
from tracemill.sources.runs import (
    any_case,
    as_list,
    data_depth,
    files_in,
    literal,
    qualified,
    run_folders,
    run_key,
    shared_folder,
    source_path,
)

# Files whose layout one task reads, when they are given as a list.
FOOTERS_PER_TASK = 64

# A csv file in the lookup of headers: path, number of the header.
_FILE_BYTES = 512

# Csv files are read as texts: what a text means is known to who asks for it.
CSV_OPTIONS = {"header": "true"} | QUOTING


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in SUPPORTED_SUFFIXES:
        raise ValueError(f"unsupported file format: {suffix or name}")
    return suffix


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One parquet or csv file, with clean column names."""
    return strip_names(_naive_times(_read(spark, suffix_of(path), [path])))


def _read(
    spark: SparkSession,
    suffix: str,
    paths: Sequence[str],
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    exact = [literal(path) for path in paths]
    if suffix == ".csv":
        return reader.options(**CSV_OPTIONS).csv(exact)
    return reader.parquet(*exact)


def _naive_times(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: col(name).cast(NTZ) for name in zoned}) if zoned else df


def available_columns(columns: Iterable[str], requested: Sequence[str] | None) -> list[str]:
    """The requested columns that exist, in request order; all when ``None``."""
    present = list(columns)
    if requested is None:
        return present
    return [name for name in dict.fromkeys(requested) if name in present]


def layout_reader():
    """Function for ``mapInPandas`` that names the layout of each file."""
    return footer_reader()


def file_layouts(files: DataFrame) -> DataFrame:
    """Add to each file (``path``, ``suffix``) a text that names its layout."""
    return file_catalogue(files).select("path", "suffix", "layout")


def _tagged(
    df: DataFrame,
    columns: Sequence[str] | None,
    root: str,
    roles: Roles,
    shared: tuple[str, str] | None = None,
) -> DataFrame:
    """Clean names, wanted columns only, plus the source file and the run.

    The run is an expression over the file path alone: a filter on it reaches
    the file listing.
    """
    path = source_path(F.col("_metadata.file_path"))
    clean = strip_names(_naive_times(df.drop("_metadata")))
    own = available_columns(clean.columns, columns)
    if roles.source in clean.columns and roles.source not in own:
        own.append(roles.source)
    tags = {roles.source: path, roles.run: run_key(path, root, shared)}
    if columns is not None:
        # A projected read keeps a tag column that the file brings itself.
        tags = {name: tag for name, tag in tags.items() if name not in own}
    # Tagged before the names are cleaned, since only the scan has _metadata.
    wide = df.withColumns({f"__tag_{name}": tag for name, tag in tags.items()})
    wide = strip_names(_naive_times(wide))
    return wide.select(
        *[col(name) for name in own if name not in tags],
        *[col(f"__tag_{name}").alias(name) for name in tags],
    )


def _common_type(kinds: set[str]) -> str | None:
    """Type to cast to before a union, or ``None`` when Spark can widen itself."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    present = kinds - {"void"}
    if len(present) <= 1 or present <= numbers:
        return None
    if all(kind in numbers or kind.startswith("decimal") for kind in present):
        return "double"
    if present <= {NTZ, "date"}:
        return NTZ
    return "string"


def union_by_name(frames: Sequence[DataFrame], texts: Sequence[DataFrame] = ()) -> DataFrame:
    """Union of frames that may differ in columns and types.

    Missing columns become null. Number types widen; columns that hold numbers
    in one frame and texts in another become text. ``texts`` are frames of untyped
    texts, such as those of csv files: their columns take the type that the others
    have, and a text that does not say such a value is null.
    """
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    targets = {name: _common_type(found) for name, found in kinds.items()}
    aligned = [
        frame.select(
            *[
                col(name).cast(targets[name]).alias(name) if targets[name] else col(name)
                for name in frame.columns
            ]
        )
        for frame in frames
    ]
    if aligned and texts:
        typed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned).schema
        kind = {field.name: field.dataType for field in typed.fields}
        texts = [
            frame.select(
                *[
                    (col(name).try_cast(kind[name]) if name in kind else col(name)).alias(name)
                    for name in frame.columns
                ]
            )
            for frame in texts
        ]
    aligned += texts
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


@dataclass(frozen=True)
class Place:
    """Where files lie: in ``folders``, ``depth`` levels below ``base``; without any, in a list."""

    root: str
    folders: Sequence[str] = ()
    base: str = ""
    depth: int = 0


def _parquet(spark: SparkSession, known: DataFrame, place: Place) -> list[DataFrame]:
    """The parquet files of a catalogue, in as few reads as their types allow."""
    texts = [row["types"] for row in known.select("types").distinct().orderBy("types").collect()]
    if None in texts:
        return _parquet_by_schema(spark, place.folders or [r["path"] for r in known.collect()])
    layouts = {tuple((name, kind) for name, kind in json.loads(text)): text for text in texts}
    groups = layout_groups(list(layouts))
    numbers = rows_frame(
        spark,
        [(layouts[types], i) for i, members in enumerate(groups) for types in members],
        "types string, group int",
    )
    # As many rows as there are layouts.
    files = known.join(F.broadcast(numbers), "types").select("path", "types", "group")
    return _grouped_reads(spark, files, groups, place)


def _grouped_reads(
    spark: SparkSession, files: DataFrame, groups: list[list], place: Place, whole: bool = True
) -> list[DataFrame]:
    """One read for each group of parquet files; files of group -1 are left out.

    ``whole`` says that there are no files of group -1.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": any_case(".parquet")}
    if place.folders and whole and len(groups) == 1:
        paths = {0: list(place.folders)}
    elif place.folders:
        paths = covers(files.select("path", "group"), place.base, place.depth)
    else:
        paths, options = {}, {}
        for row in files.orderBy("path").toLocalIterator():
            paths.setdefault(row["group"], []).append(row["path"])
    frames = []
    for number, members in enumerate(groups):
        if number not in paths:
            continue
        schema = group_schema(members)
        if schema is None:
            # One file of each layout is enough for Spark to see the types.
            samples = files.where(F.col("group") == number).groupBy("types").agg(F.min("path").alias("path"))
            seen = [row["path"] for row in samples.orderBy("path").collect()]
            schema = _read(spark, ".parquet", seen, mergeSchema="true").schema
        frames.append(_read(spark, ".parquet", paths[number], schema, **options))
    return frames


def _parquet_by_schema(spark: SparkSession, places: Sequence[str]) -> list[DataFrame]:
    """All parquet files below the folders, where only Spark's readers reach them.

    Spark unites the columns that files have. It refuses columns of different types;
    then each folder is a read of its own.
    """
    options = {
        "mergeSchema": "true",
        "recursiveFileLookup": "true",
        "pathGlobFilter": any_case(".parquet"),
    }
    try:
        return [_read(spark, ".parquet", places, **options)]
    except (PySparkException, Py4JJavaError) as error:
        if "UNABLE_TO_INFER_SCHEMA" in str(error):  # a run without parquet files
            return []
        if "CANNOT_MERGE" not in str(error) or len(places) < 2:
            raise
    return [frame for place in places for frame in _parquet_by_schema(spark, [place])]


def _csv(
    spark: SparkSession, layouts: DataFrame, folders: Sequence[str], place: Place | None = None
) -> list[DataFrame]:
    """All csv files below the folders, or listed in ``layouts``, as texts.

    Files in which a quoted text may go over a line's end are read by ``csv_records``, the
    others by Spark's reader. ``place`` says where the files lie, if not in a list.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": any_case(".csv")} if folders else {}
    places = folders or [row["path"] for row in layouts.select("path").orderBy("path").collect()]
    torn = torn_files(spark, places, options)
    if torn.isEmpty():
        return [_csv_rows(spark, layouts, places, options)]
    known = layouts.withColumn("plain", plain_path(F.col("path")))
    known = durable(known.join(torn.select(F.col("path").alias("torn")), F.col("plain") == F.col("torn"), "left"))
    frames = []
    for group, rows in enumerate((known.where("torn is null"), known.where("torn is not null"))):
        if rows.isEmpty():
            continue
        if place and place.folders:
            marked = known.select("path", F.when(F.col("torn").isNull(), 0).otherwise(1).alias("group"))
            own = covers(marked, place.base, place.depth)[group]
        else:
            own = [row["path"] for row in rows.select("path").orderBy("path").collect()]
        frames.append(_csv_rows(spark, rows, own, options, records=group == 1))
    return frames


def _csv_rows(
    spark: SparkSession,
    layouts: DataFrame,
    places: Sequence[str],
    options: dict[str, str],
    records: bool = False,
) -> DataFrame:
    """Rows of csv files with the names that their headers give.

    With one header, that is all. Else all files are read by position, and a column takes
    its text from the place that the header of the row's file gives it: one read, and as
    many choices as there are headers.
    """
    headers = [row["layout"] for row in layouts.select("layout").distinct().orderBy("layout").collect()]
    named = [next(csv.reader([header])) for header in headers]
    most = max(map(len, named))

    def read(names: Sequence[str]) -> DataFrame:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        if not records:
            return _read(spark, ".csv", places, schema, **options)
        fields = ", ".join(f"{quoted(name)} string" for name in names)
        found = csv_records(spark, places, options)
        parsed = found.select(F.from_csv("text", fields, QUOTING).alias("row"), "path", "start")
        seen = F.struct(_escaped(F.col("path")).alias("file_path"), F.col("start").alias("file_block_start"))
        return parsed.select("row.*", seen.alias("_metadata"))

    if len(headers) == 1:
        return read(_distinct(named[0]))
    positions = [f"_c{i}" for i in range(most)]
    rows = read(positions)
    numbers = rows_frame(spark, [(h, i) for i, h in enumerate(headers)], "layout string, __header int")
    own = layouts.join(numbers, "layout").select(plain_path(F.col("path")).alias("__at"), "__header")
    # As many rows as files; each row of a file finds its header by the file's path. A few
    # large files are few keys: by these alone, all rows of a file would meet in one task.
    known = rows.withColumns(
        {
            "__at": plain_path(source_path(F.col("_metadata.file_path"))),
            "__start": F.col("_metadata.file_block_start"),
            "__file": F.col("_metadata"),
        }
    )
    known = lookup_join(known, durable(own), ["__at"], ["__start", *positions], _FILE_BYTES)
    columns = {}
    for number, names in enumerate(map(_distinct, named)):
        for place, name in enumerate(names):
            columns.setdefault(name, []).append((number, place))
    picked = [
        F.coalesce(*[F.when(F.col("__header") == n, F.col(f"_c{place}")) for n, place in where]).alias(name)
        for name, where in columns.items()
    ]
    return known.select(*picked, F.col("__file").alias("_metadata"))


def _escaped(path: Column) -> Column:
    """A path as the reader's metadata have it, so that ``source_path`` gives it back."""
    full = F.regexp_replace(path, "^file:/+", "file:///")
    return F.replace(F.replace(full, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))


def _distinct(names: Sequence[str]) -> list[str]:
    """Names of a header; one that comes again, or is empty, is told by its place."""
    out: list[str] = []
    for place, name in enumerate(names):
        out.append(name if name and name not in out else f"{name}_{place}")
    return out


def _load(
    spark: SparkSession,
    files: DataFrame,
    place: Place,
    columns: Sequence[str] | None,
    roles: Roles,
    shared: tuple[str, str] | None = None,
    unseen: DataFrame | None = None,
) -> DataFrame:
    """Files of both kinds, united, after one look at all their footers and headers.

    ``unseen`` are files that Spark's readers do not see.
    """
    known = file_catalogue(files)
    kinds = {row["suffix"] for row in known.select("suffix").distinct().collect()}
    hidden = hidden_frames(spark, unseen) if unseen is not None else ([], [])
    if not kinds and not any(hidden):
        raise ValueError("no input files")
    typed: list[DataFrame] = []
    texts: list[DataFrame] = []
    if ".parquet" in kinds:
        typed = _parquet(spark, known.where("suffix = '.parquet'"), place)
    if ".csv" in kinds:
        texts = _csv(spark, known.where("suffix = '.csv'"), place.folders, place)
    typed = [_tagged(df, columns, place.root, roles, shared) for df in typed + hidden[0]]
    texts = [_tagged(df, columns, place.root, roles, shared) for df in texts + hidden[1]]
    return union_by_name(typed, texts)


def load_runs(
    spark: SparkSession,
    root: str,
    runs: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    data_path: str | None = None,
    roles: Roles = Roles(),
    hidden: bool = False,
) -> DataFrame:
    """All files of the chosen runs as one frame, tagged with file and run.

    Only folders of chosen runs are listed. Starts small jobs that read footers and
    headers; the data itself is read lazily. ``hidden`` asks for files, too, whose names,
    or folders below the run's own, begin with ``_`` or ``.``: Spark leaves these out, and
    they may be what a job that writes has not finished.
    """
    folders = run_folders(spark, root, runs, data_path)
    shared = shared_folder(spark, root, data_path)
    files = files_in(spark, folders, root, shared)
    place = _place(spark, root, folders, data_path, shared)
    unseen = list_tree(spark, folders, root, shared).where("hidden") if hidden else None
    return _load(spark, files, place, columns, roles, shared, unseen)


def _place(
    spark: SparkSession,
    root: str,
    folders: Sequence[str],
    data_path: str | None,
    shared: tuple[str, str] | None,
) -> Place:
    full = qualified(spark, root)
    if shared:  # all files lie in that one folder
        return Place(full, folders, shared[0], 0)
    return Place(full, folders, full, data_depth(data_path))


def time_bounds_of_runs(
    spark: SparkSession,
    root: str,
    column: str,
    runs: str | Sequence[str] | None = None,
    data_path: str | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """First and last date of a time column as ``min_date`` and ``max_date``.

    Taken from the statistics of row groups where parquet files have them for all of
    theirs; the column itself is read only from the other files: texts, and times of a
    kind without statistics. Texts are read in one layout per run, as in ``fact_table``.
    Without files, or where none has the column, both dates are null.
    """
    folders = run_folders(spark, root, runs, data_path)
    shared = shared_folder(spark, root, data_path)
    known = file_catalogue(files_in(spark, folders, root, shared), [column])
    bounds = time_bounds(known, column)
    left = without_bounds(known, column).select("path", "suffix", "layout", "types")
    frames = []
    if not left.isEmpty():
        frames = _with_column(spark, known, left, column, _place(spark, root, folders, data_path, shared))
    for frame in frames:
        tagged = _tagged(frame, [column, roles.run], qualified(spark, root), roles, shared)
        days = datetime_bounds(tagged, column, roles)
        bounds = bounds.unionByName(days.select(*(F.col(c).cast(NTZ).alias(n) for c, n in zip(days.columns, bounds.columns))))
    return bounds.agg(
        F.min("low").cast("date").alias("min_date"), F.max("high").cast("date").alias("max_date")
    )


def _with_column(
    spark: SparkSession, known: DataFrame, left: DataFrame, column: str, place: Place
) -> list[DataFrame]:
    """Reads of the files of ``left`` that have the column, and of no others."""
    frames = []
    texts = [row["types"] for row in left.where("suffix = '.parquet'").select("types").distinct().collect()]
    if None in texts:
        return [
            frame
            for frame in _parquet_by_schema(spark, place.folders)
            if column in map(str.strip, frame.columns)
        ]
    layouts = {tuple((name, kind) for name, kind in json.loads(text)): text for text in texts}
    having = [types for types in layouts if column in (name.strip() for name, _ in types)]
    if having:
        # Only this column: files differ by its type alone, not by those of others.
        cut = {types: tuple(x for x in types if x[0].strip() == column) for types in having}
        groups = layout_groups(sorted(set(cut.values())))
        of = {types: i for i, members in enumerate(groups) for types in members}
        numbers = rows_frame(
            spark, [(layouts[types], of[cut[types]]) for types in having], "types string, group int"
        )
        asked = left.select("path").withColumn("asked", F.lit(1))
        files = known.where("suffix = '.parquet'").join(asked, "path", "left")
        files = files.join(F.broadcast(numbers), "types", "left").select(
            "path", "types", F.when(F.col("asked").isNotNull(), F.col("group")).alias("group")
        )
        files = files.na.fill(-1, ["group"])
        frames += _grouped_reads(spark, files, groups, place, whole=False)
    headed = left.where("suffix = '.csv'")
    if not headed.isEmpty():
        frames += [
            frame
            for frame in _csv(spark, headed, place.folders, place)
            if column in map(str.strip, frame.columns)
        ]
    return frames


def load_chosen(
    spark: SparkSession,
    root: str,
    files: DataFrame,
    chosen: DataFrame,
    data_path: str | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """Some of the files of runs as one frame, tagged with file and run.

    ``files`` lists all files (``path``, ``suffix``), ``chosen`` the paths of those to load.
    Folders of which all files are chosen are named as folders, so the plan does not grow
    with the files where whole folders are loaded.
    """
    shared = shared_folder(spark, root, data_path)
    place = _place(spark, root, (), data_path, shared)
    known = file_catalogue(files.join(chosen.select("path"), "path", "left_semi"))
    typed: list[DataFrame] = []
    texts: list[DataFrame] = []
    parquet = known.where("suffix = '.parquet'")
    layouts = {
        tuple((name, kind) for name, kind in json.loads(row["types"])): row["types"]
        for row in parquet.select("types").distinct().collect()
    }
    if layouts:
        groups = layout_groups(list(layouts))
        numbers = rows_frame(
            spark,
            [(layouts[types], i) for i, members in enumerate(groups) for types in members],
            "types string, group int",
        )
        own = parquet.join(F.broadcast(numbers), "types").select("path", "types", "group")
        marked = files.where("suffix = '.parquet'").select("path").join(own, "path", "left")
        within = replace(place, folders=("",))
        typed = _grouped_reads(spark, marked.na.fill(-1, ["group"]), groups, within, whole=False)
    headed = known.where("suffix = '.csv'")
    if not headed.isEmpty():
        own = headed.select("path", F.lit(0).alias("group"))
        marked = files.where("suffix = '.csv'").select("path").join(own, "path", "left")
        own = covers(marked.na.fill(-1, ["group"]), place.base, place.depth)[0]
        texts = _csv(spark, headed, own, replace(place, folders=own))
    if not typed and not texts:
        raise ValueError("no input files")
    typed = [_tagged(df, None, place.root, roles, shared) for df in typed]
    texts = [_tagged(df, None, place.root, roles, shared) for df in texts]
    return union_by_name(typed, texts)


def load_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    root: str,
    columns: Sequence[str] | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """The given files as one frame, tagged with file and run."""
    chosen = [qualified(spark, path) for path in as_list(paths)]
    if not chosen:
        raise ValueError("no input files")
    files = rows_frame(
        spark, [(path, suffix_of(path)) for path in chosen], "path string, suffix string"
    ).repartition(1 + len(chosen) // FOOTERS_PER_TASK)
    return _load(spark, files, Place(qualified(spark, root)), columns, roles)
