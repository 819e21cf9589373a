"""Profiles of columns: kinds, time columns, date bounds, distinct values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.clean import chosen_layouts, read_times, with_time
from tracemill.operators.shapes import AmbiguousTimes, Inferred, Shapes, shapes_by_group
from tracemill.roles import Roles, col
from tracemill.session import rows_frame

# Parts of a name that mark a time column, and the share of texts
# that have to be times.
TIME_WORDS = ("datetime", "date", "time", "hour", "timestamp")
TIME_SHARE = 0.9


def looks_like_time(name: str) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in TIME_WORDS)


def time_columns_by_name(df: DataFrame) -> list[str]:
    return [name for name in df.columns if looks_like_time(name)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def filled_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``column``, ``rows`` of the table and ``filled`` ones.

    One pass and one row of counts, whatever the size of the table.
    """
    counts = [F.count(col(name)).alias(f"c{i}") for i, name in enumerate(df.columns)]
    pairs = [
        F.struct(F.lit(name).alias("column"), F.col("rows"), F.col(f"c{i}").alias("filled"))
        for i, name in enumerate(df.columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts).select(F.inline(F.array(*pairs)))


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and whether time or numeric.

    Derived from the schema, so no data is read.
    """
    times, numbers = set(time_columns_by_name(df)), set(numeric_columns(df))
    rows = [
        (i, f.name, f.dataType.simpleString(), f.name in times, f.name in numbers)
        for i, f in enumerate(df.schema.fields)
    ]
    return rows_frame(
        df.sparkSession, rows, "ordinal int, column string, type string, is_time boolean, is_numeric boolean"
    )


def detect_time_columns(df: DataFrame, roles: Roles = Roles()) -> list[str]:
    """Columns that hold times, by name and then by content.

    By content: of the remaining text columns, those where more than 90 % of the
    non-null values are times. Columns with another role are no candidates. Starts
    one job when there are such text columns, which shuffles shapes and no texts; columns
    whose shapes leave it open are read in the layouts in question by a second one.
    """
    named = time_columns_by_name(df)
    texts = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        and f.name not in named
        and f.name not in roles.dimensions
    ]
    if not texts:
        return named
    pairs = [F.struct(F.lit(name).alias("group"), col(name).alias("text")) for name in texts]
    values = df.select(F.inline(F.array(*pairs))).where("text is not null")
    found = shapes_by_group(values)
    # Most texts are no times in any layout, and their shapes say so.
    likely = {name: shapes for name, shapes in found.items() if shapes.most_times() > TIME_SHARE * shapes.total}
    layouts = {name: layout or _inferred(likely[name]) for name, layout in chosen_layouts(values, likely).items()}
    shares = {name: _share(likely[name], layout) for name, layout in layouts.items() if layout}
    open_ = [name for name, enough in shares.items() if enough is None]
    if open_:
        asked = list(dict.fromkeys(layouts[name] for name in open_))
        reads = [
            F.sum(F.when(read_times(F.col("text"), layout).isNotNull(), 1).otherwise(0)).alias(f"fits_{i}")
            for i, layout in enumerate(asked)
        ]
        counted = values.where(F.col("group").isin(open_)).groupBy("group")
        for row in counted.agg(F.count(F.lit(1)).alias("rows"), *reads).collect():
            fits = row[f"fits_{asked.index(layouts[row['group']])}"]
            shares[row["group"]] = fits > TIME_SHARE * row["rows"]
    return named + [name for name in texts if shares.get(name)]


def _inferred(shapes: Shapes) -> Inferred | None:
    try:
        return shapes.infer()
    except AmbiguousTimes:  # times, though not in which order
        return None


def _share(shapes: Shapes, layout: str | Inferred) -> bool | None:
    """Whether more than the needed share are times; ``None``: the shapes do not tell."""
    if isinstance(layout, Inferred):
        return None
    return shapes.share(layout, math.floor(TIME_SHARE * shapes.total) + 1)


def datetime_bounds(df: DataFrame, column: str, roles: Roles = Roles()) -> DataFrame:
    """First and last date as ``min_date``, ``max_date``, null when there is none.

    Texts are read in the layout of their run, which a job finds from their shapes, so
    the bounds are those of the times; texts that are no times do not count. Only this
    column is read, no text is shuffled, and each task hands on two values.
    """
    if column not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("date").alias("min_date"), F.lit(None).cast("date").alias("max_date")
        )
    per = roles.run if roles.run in df.columns else None
    values = df.select(*[col(name) for name in dict.fromkeys((column, per)) if name])
    timed = with_time(values, column, per, strict=False)
    return timed.agg(
        F.min(col(column)).cast("date").alias("min_date"),
        F.max(col(column)).cast("date").alias("max_date"),
    )


# The texts that a task keeps of a column.
_LEAST = "ordinal int, value string"


def wide_profile(df: DataFrame, columns: Sequence[str], examples: int = 10) -> DataFrame:
    """What ``column_profile`` gives, for columns that may have a value per row.

    Columns are summed up one by one, not by their combinations. The first examples are
    the least texts of every task, so at most ``examples`` rows a task and column move.
    Distinct values are counted by ranges of a 128-bit hash: what moves of a value is its
    hash, once for each task that has it, and no task holds more than a range.
    """
    spark = df.sparkSession
    asked = rows_frame(
        spark,
        [(i, name, name not in df.columns) for i, name in enumerate(columns)],
        "ordinal int, column string, missing boolean",
    )
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    present = [(i, name) for i, name in enumerate(columns) if name in df.columns]
    texts = df.select(*[col(name).cast("string").alias(f"c{i}") for i, name in present])
    counts = _distinct_counts(texts, [i for i, _ in present])
    least = least_values(texts, [i for i, _ in present], examples)
    shown = least.groupBy("ordinal").agg(
        F.slice(F.array_sort(F.collect_set("value")), 1, examples).alias("examples")
    )
    return (
        asked.crossJoin(F.broadcast(total))  # one row
        .join(counts, "ordinal", "left")
        .join(shown, "ordinal", "left")
        .select(
            "ordinal",
            "column",
            "missing",
            "rows",
            F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
            F.when(F.size("examples") > 0, F.col("examples")).alias("examples"),
        )
    )


def _distinct_counts(texts: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    """Distinct non-null values of each column by the hashes of their texts."""
    hashes = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.xxhash64(f"c{i}").alias("one"),
            F.xxhash64(F.concat(F.lit("2"), F.col(f"c{i}"))).alias("two"),
            F.col(f"c{i}").isNotNull().alias("filled"),
        )
        for i in ordinals
    ]
    if not hashes:
        return rows_frame(texts.sparkSession, [], "ordinal int, distinct_values bigint")
    rows = texts.select(F.inline(F.array(*hashes))).where("filled")
    return (
        rows.select("ordinal", "one", "two")
        .distinct()
        .groupBy("ordinal")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
    )


def least_values(texts: DataFrame, ordinals: Sequence[int], examples: int) -> DataFrame:
    """The least texts of each column ``c<ordinal>`` in every task: ``ordinal``, ``value``."""
    numbers = list(ordinals)

    def least(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = {i: pa.array([], pa.string()) for i in numbers}
        for batch in batches:
            for place, i in enumerate(numbers):
                found = batch.column(place).drop_null()
                if len(held[i]) == examples and examples:
                    found = found.filter(pc.less(found, held[i][-1]))
                if not len(found):
                    continue
                both = pa.concat_arrays([held[i], pc.unique(found).cast(pa.string())])
                both = pc.unique(both)
                # Texts sort by their bytes, as Spark has them.
                held[i] = both.take(pc.array_sort_indices(both))[:examples]
        for i, values in held.items():
            if len(values):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(values), pa.int32()), values], ["ordinal", "value"]
                )

    if not numbers:
        return rows_frame(texts.sparkSession, [], _LEAST)
    return texts.mapInArrow(least, _LEAST)


def column_profile(df: DataFrame, columns: Sequence[str], examples: int = 10) -> DataFrame:
    """One row per column: rows of the table, distinct values, first examples.

    Missing columns are listed with ``missing`` set. One pass counts the rows of
    each combination of values, far fewer than rows in a table of time series;
    everything else works on those counts. It is meant for dimensions: a column
    with a value per row makes that many combinations, and is for ``wide_profile``. ``examples`` says how many of
    the first values in text order are shown, by a ranking that Spark cuts off in
    each task.
    """
    spark = df.sparkSession
    asked = rows_frame(
        spark,
        [(i, name, name not in df.columns) for i, name in enumerate(columns)],
        "ordinal int, column string, missing boolean",
    )
    present = [name for name in columns if name in df.columns]
    combinations = df.groupBy(*map(col, present)).agg(F.count(F.lit(1)).alias("__rows"))
    pairs = [
        F.struct(
            F.lit(name).alias("column"),
            (col(name) if name in present else F.lit(None)).cast("string").alias("value"),
        )
        for name in columns
    ]
    values = (
        combinations.select("__rows", F.explode(F.array(*pairs)).alias("pair"))
        .groupBy("pair.column", "pair.value")
        .agg(F.sum("__rows").alias("rows"))
    )
    counts = values.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.count("value").alias("distinct_values")
    )
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    shown = (
        # Asking for the rows as well keeps this the same shuffle as for the counts.
        values.where("value is not null and rows > 0")
        .select("column", "value", rank.alias("rank"))
        .where(F.col("rank") <= examples)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("examples"))
    )
    return (
        asked.join(counts, "column", "left")
        .join(shown, "column", "left")
        .select(
            "ordinal",
            "column",
            "missing",
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
            "examples",
        )
    )
