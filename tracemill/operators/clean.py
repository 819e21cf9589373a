"""From raw columns to a fact table with parsed times and numeric values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.time import HINT, LAYOUTS, NTZ, parse_time
from tracemill.functions.values import to_number
from tracemill.operators.shapes import (
    AmbiguousTimes,
    Inferred,
    Shapes,
    candidates,
    exact_fits,
    shapes_by_group,
)
from tracemill.roles import Roles, col

# Fixed value: share of rows that the hint layout has to fit.
HINT_SHARE = 0.8


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks.

    Columns whose names become equal are merged, first non-null value first.
    """
    merged: dict[str, list[str]] = {}
    for name in df.columns:
        merged.setdefault(name.strip(), []).append(name)
    return df.select(
        *[
            (col(names[0]) if len(names) == 1 else F.coalesce(*map(col, names))).alias(clean)
            for clean, names in merged.items()
        ]
    )


class UnknownTimes(ValueError):
    """Texts of a time column that no layout fits."""


@dataclass(frozen=True)
class Reading:
    """How the times of a group are read: by a known layout, one found from shapes, or not."""

    layout: str | Inferred | None
    filled: int


def time_readings(df: DataFrame, column: str, per: str | None = None) -> dict[str, Reading]:
    """The layout of a text column for each value of ``per``; it decides once.

    The hint layout is taken when it fits at least 80 % of the rows (null counts as a
    misfit), else the known layout that fits most rows. Where none fits any, one is found
    from the shapes of the texts; ``None`` when these are no times either. ``per`` is a
    column of few values, such as the run; without it there is one decision, under the
    key ``""``.

    Starts a job that sums up shapes, and a second one for groups whose shapes leave open
    which layout fits most: these are read in the layouts in question. Neither shuffles
    texts. Dates that may be read in several orders raise ``AmbiguousTimes``.
    """
    group = F.coalesce(col(per).cast("string"), F.lit("")) if per else F.lit("")
    texts = df.select(group.alias("group"), col(column).alias("text"))
    return readings_of(texts, shapes_by_group(texts), column)


def readings_of(texts: DataFrame, found: dict[str, Shapes], column: str) -> dict[str, Reading]:
    """The layout of each group of ``texts`` (``group``, ``text``), whose shapes are ``found``."""
    chosen = chosen_layouts(texts, found)
    readings = {}
    for name, shapes in found.items():
        layout = chosen[name]
        if layout is None and shapes.filled:
            try:
                layout = shapes.infer()
            except AmbiguousTimes as error:
                raise AmbiguousTimes(f"column {column!r}, {name or 'all rows'}: {error}") from None
        readings[name] = Reading(layout, shapes.filled)
    return readings


def chosen_layouts(texts: DataFrame, found: dict[str, Shapes]) -> dict[str, str | None]:
    """The known layout of each group of ``texts``, whose shapes are ``found``."""
    chosen: dict[str, str | None] = {}
    unclear = []
    for name, shapes in found.items():
        decided, layout = shapes.decide(HINT_SHARE)
        if decided:
            chosen[name] = layout
        else:
            unclear.append(name)
    if unclear:
        asked = list(dict.fromkeys([HINT, *candidates([found[name] for name in unclear])]))
        fits = exact_fits(texts.where(F.col("group").isin(unclear)), asked, parse_time)
        chosen |= {row["group"]: choose_layout(row.asDict()) for row in fits.collect()}
    return chosen


def fits_hint(fits: dict[str, int]) -> bool:
    return fits["rows"] > 0 and fits[HINT] >= HINT_SHARE * fits["rows"]


def choose_layout(fits: dict[str, int]) -> str | None:
    if fits_hint(fits):
        return HINT
    others = [layout for layout in LAYOUTS if layout != HINT and layout in fits]
    best = max(others, key=fits.__getitem__, default=None)
    return best if best and fits[best] else None


def read_times(text: Column, layout: str | Inferred) -> Column:
    return layout.parse(text) if isinstance(layout, Inferred) else parse_time(text, layout)


def with_time(
    df: DataFrame,
    column: str,
    per: str | None = None,
    strict: bool = True,
    readings: dict[str, Reading] | None = None,
) -> DataFrame:
    """Replace a time column by its parsed form.

    Times pass through, texts are parsed in the layouts of ``time_readings``, and
    numbers are refused: an integer hour of the day is no point in time. Where a
    group has texts and no layout fits any of them, ``UnknownTimes`` is raised and
    names the groups; with ``strict=False`` their times are null. ``readings`` are known
    layouts; without them a job finds these.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return df.withColumn(column, col(column).cast(NTZ))
    if not isinstance(kind, T.StringType):
        raise TypeError(f"column {column!r} of type {kind.simpleString()} holds no times")
    groups: dict[str | Inferred, list[str]] = {}
    unknown: dict[str, int] = {}
    if readings is None:
        readings = time_readings(df, column, per)
    for name, reading in readings.items():
        if reading.layout:
            groups.setdefault(reading.layout, []).append(name)
        elif reading.filled:
            unknown[name] = reading.filled
    if unknown and strict:
        found = ", ".join(f"{name or 'all rows'} ({n} texts)" for name, n in sorted(unknown.items()))
        raise UnknownTimes(f"no layout fits the times of column {column!r}: {found}")
    parsed = F.lit(None).cast(NTZ)
    for layout, names in groups.items():
        here = read_times(col(column), layout)
        if len(groups) > 1:
            here = F.when(F.coalesce(col(per).cast("string"), F.lit("")).isin(names), here)
            here = here.otherwise(parsed)
        parsed = here
    return df.withColumn(column, parsed)


def with_number(df: DataFrame, column: str) -> DataFrame:
    """Make the value column a double, with NaN as null.

    Rows whose text is no number are dropped; a numeric column keeps its nulls.
    """
    kind = df.schema[column].dataType
    numeric = df.withColumn(column, to_number(col(column), kind))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return numeric
    return numeric.where(col(column).isNotNull())


def fact_table(
    df: DataFrame,
    roles: Roles = Roles(),
    strict: bool = True,
    readings: dict[str, Reading] | None = None,
) -> DataFrame:
    """Rows with a valid time, parsed times and numeric values.

    Runs may write their times in different layouts. A run whose times fit no
    layout at all is an error, unless ``strict`` is off: then its rows are dropped.
    ``readings`` are the runs' layouts where they are known.
    """
    per = roles.run if roles.run in df.columns else None
    clean = with_number(with_time(df, roles.time, per, strict, readings), roles.value)
    return clean.where(col(roles.time).isNotNull())
