"""What the files of run folders hold, from one pass over footers and headers.

One distributed job opens every file once: of a parquet file it reads the footer, of a
csv file the first line. From that the reads are planned: files go together unless a
column has different types in them, so there are as many scans as there are layouts that
exclude one another, whatever the number of runs and files. The job also hands on the
statistics that parquet files keep of their row groups, which answer some questions
without reading any column.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.time import NTZ
from tracemill.session import durable

CATALOGUE = (
    "path string, suffix string, layout string, types string, "
    "statistics array<struct<column string, kind string, low bigint, high bigint, complete boolean>>"
)


def footer_reader(statistics: Sequence[str] = ()):
    """Function for ``mapInPandas`` that reads footers and headers of files.

    For each file: a text that names its layout; for parquet its columns and their types
    as JSON; and for each column of ``statistics`` (clean names) that holds times, the
    first and last one (microseconds or days from 1970) over all row groups, and whether
    all row groups tell. A file that cannot be opened from a task has no layout.

    It refers to nothing outside itself, so workers need not have this package.
    """
    wanted = list(statistics)

    def uri(path):
        # "file:/a b" is not a valid URI for Arrow, and s3a is known as s3.
        if path.startswith("file:"):
            return "/" + path[len("file:") :].lstrip("/")
        return path.replace("s3a://", "s3://", 1)

    def first_line(handle):
        # Breaks inside quotes belong to a name.
        line = b""
        while True:
            block = handle.read(64 * 1024)
            line += block
            at = -1
            while (at := line.find(b"\n", at + 1)) >= 0:
                if line.count(b'"', 0, at) % 2 == 0:
                    line, block = line[:at], b""
                    break
            if not block:
                return line.strip(b"\r\xef\xbb\xbf").decode("utf-8", "replace")

    def type_of(column):
        """Spark's name of the type of a column, as its reader takes it; ? if none is known."""
        rules = json.loads(column.logical_type.to_json())
        name, physical = rules.get("Type"), column.physical_type
        if name == "Decimal":
            return f"decimal({rules['precision']},{rules['scale']})"
        if name == "Timestamp" and rules["timeUnit"] != "nanoseconds":
            return "timestamp" if rules["isAdjustedToUTC"] else "timestamp_ntz"
        if name == "Int":
            signed = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
            plain = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)"}
            return (signed if rules["isSigned"] else plain)[rules["bitWidth"]]
        named = {"Date": "date", "String": "string", "Enum": "string", "JSON": "string"}
        if name in named:
            return named[name]
        if name not in (None, "None"):
            return "?"
        plain = {"BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "INT96": "timestamp"}
        plain |= {"FLOAT": "float", "DOUBLE": "double", "BYTE_ARRAY": "binary"}
        return plain.get(physical, "?")

    def times(meta, place, name):
        """First and last time of a column by the statistics of its row groups."""
        column = meta.schema.column(place)
        rules = json.loads(column.logical_type.to_json())
        unit = {"milliseconds": 1000, "microseconds": 1}.get(rules.get("timeUnit"))
        if rules.get("Type") == "Date":
            kind, factor = "date", 1
        elif rules.get("Type") == "Timestamp" and unit:
            kind, factor = "timestamp" if rules["isAdjustedToUTC"] else "timestamp_ntz", unit
        else:
            return {"column": name, "kind": None, "low": None, "high": None, "complete": False}
        low = high = None
        complete = True
        for group in range(meta.num_row_groups):
            found = meta.row_group(group).column(place).statistics
            rows = meta.row_group(group).num_rows
            if found is not None and found.has_null_count and found.null_count == rows:
                continue
            if found is None or not found.has_min_max:
                complete = False
                break
            low = found.min_raw if low is None else min(low, found.min_raw)
            high = found.max_raw if high is None else max(high, found.max_raw)
        tell = complete and low is not None
        return {
            "column": name,
            "kind": kind,
            "low": low * factor if tell else None,
            "high": high * factor if tell else None,
            "complete": complete,
        }

    def footer(handle):
        import pyarrow.parquet as pq

        meta = pq.read_metadata(handle)
        types, found = [], []
        for place in range(len(meta.schema)):
            column = meta.schema.column(place)
            flat = column.path == column.name and column.max_repetition_level == 0
            top = column.name if flat else column.path.split(".")[0]
            kind = type_of(column) if flat else "?"
            if [top, kind] not in types:
                types.append([top, kind])
            if flat and top.strip() in wanted:
                found.append(times(meta, place, top.strip()))
        return "; ".join(f"{name}: {kind}" for name, kind in types), json.dumps(types), found

    def look(path, suffix):
        from pyarrow import fs

        try:
            store, inner = fs.FileSystem.from_uri(uri(path))
        except (OSError, ValueError, NotImplementedError):
            return None, None, []  # a store that only Spark's readers know
        if suffix == ".parquet":
            with store.open_input_file(inner) as handle:
                return footer(handle)
        with store.open_input_stream(inner) as handle:
            return first_line(handle), None, []

    def footers(batches):
        for batch in batches:
            seen = [look(*file) for file in zip(batch["path"], batch["suffix"])]
            names = ("layout", "types", "statistics")
            yield batch[["path", "suffix"]].assign(
                **{name: [row[i] for row in seen] for i, name in enumerate(names)}
            )

    return footers


def file_catalogue(files: DataFrame, statistics: Sequence[str] = ()) -> DataFrame:
    """What the files (``path``, ``suffix``) hold; see ``footer_reader``.

    Files listed by Spark come in partitions by size, as for reading them. The result
    is written to the shared folder, so that each file is opened once.
    """
    return durable(files.select("path", "suffix").mapInPandas(footer_reader(statistics), CATALOGUE))


Types = tuple[tuple[str, str], ...]


def layout_groups(layouts: Sequence[Types]) -> list[list[Types]]:
    """Layouts that one scan can read, together.

    Two layouts exclude one another if a column has different types in them, or names
    that differ in case only. A layout without such a column goes with the first others.
    """
    variants: dict[str, set] = {}
    for types in layouts:
        for name, kind in types:
            variants.setdefault(name.lower(), set()).add((name, kind))
    contested = sorted(key for key, found in variants.items() if len(found) > 1)

    def key(types: Types) -> tuple:
        own = {name.lower(): (name, kind) for name, kind in types}
        return tuple(own.get(name) for name in contested)

    groups: list[tuple[list, list[Types]]] = []
    for types in sorted(layouts, key=lambda t: (-sum(x is not None for x in key(t)), t)):
        own = key(types)
        for taken, members in groups:
            if all(a is None or b is None or a == b for a, b in zip(taken, own)):
                taken[:] = [b if a is None else a for a, b in zip(taken, own)]
                members.append(types)
                break
        else:
            groups.append((list(own), [types]))
    return [members for _, members in groups]


def group_schema(members: Sequence[Types]) -> T.StructType | None:
    """The columns of some layouts; ``None`` if Spark itself has to look at a type."""
    columns: dict[str, str] = {}
    for types in members:
        for name, kind in types:
            columns.setdefault(name, kind)
    if "?" in columns.values():
        return None
    plain = {"timestamp_ntz": T.TimestampNTZType()}
    fields = []
    for name, kind in columns.items():
        found = plain[kind] if kind in plain else T._parse_datatype_string(kind)
        fields.append(T.StructField(name, found))
    return T.StructType(fields)


def covers(files: DataFrame, root: str, depth: int) -> dict[int, list[str]]:
    """Folders and files to read for each group of files, as few as there can be.

    ``files`` has columns ``path``, below ``root``, and ``group``, 0 or more for those to
    read. A folder ``depth`` levels below the root, or lower, stands for all files in it if
    these are of one group; only in folders of several groups files are named.
    """
    rest = F.split(F.substring("path", len(root) + 2, F.length("path")), "/")
    steps = F.transform(
        F.sequence(F.least(F.lit(depth), F.size(rest)), F.size(rest)),
        lambda n: F.array_join(F.concat(F.array(F.lit(root)), F.slice(rest, 1, n)), "/"),
    )
    spots = files.select("group", steps.alias("steps")).select(
        "group", "steps", F.posexplode("steps").alias("level", "spot")
    )
    above = F.when(F.col("level") > 0, F.col("steps")[F.col("level") - 1])
    pure = (
        spots.groupBy("spot", above.alias("above"))
        .agg(F.min("group").alias("group"), F.max("group").alias("most"))
        .where("group = most")
    )
    pure = durable(pure)
    higher = pure.select(F.col("spot").alias("high"))
    top = pure.join(higher, pure["above"] == higher["high"], "left_anti").where("group >= 0")
    found: dict[int, list[str]] = {}
    for row in sorted(top.select("group", "spot").collect()):
        found.setdefault(row["group"], []).append(row["spot"])
    return found


def time_bounds(known: DataFrame, column: str) -> DataFrame:
    """``low`` and ``high`` of the files whose statistics tell, as naive times."""
    found = known.select(F.inline("statistics")).where((F.col("column") == column) & F.col("complete"))

    def naive(value: str):
        instant = F.timestamp_micros(value)
        return (
            F.when(F.col("kind") == "date", F.date_from_unix_date(F.col(value).cast("int")).cast(NTZ))
            .when(F.col("kind") == "timestamp", instant.cast(NTZ))
            .otherwise(F.expr(f"timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast({value} as decimal(28,6)) / 1000000)"))
        )

    return found.agg(F.min(naive("low")).alias("low"), F.max(naive("high")).alias("high"))


def without_bounds(known: DataFrame, column: str) -> DataFrame:
    """Files that may hold times in a column, and do not tell which by their statistics."""
    told = F.exists("statistics", lambda s: (s["column"] == column) & s["complete"])
    return known.where(~F.coalesce(told, F.lit(False)))
