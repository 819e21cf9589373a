"""Roll-up of unit rows to technologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.values import nan_to_null, sum_or_zero
from tracemill.operators.profile import detect_time_columns, numeric_columns
from tracemill.roles import Roles, col


def clean_sum(df: DataFrame, name: str) -> Column:
    """Sum of a numeric column: NaN counts as null, nulls only give 0."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        value = nan_to_null(value)
    return sum_or_zero(value).alias(name)


def clean_key(df: DataFrame, name: str) -> Column:
    """A group key in which NaN is null."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return nan_to_null(col(name)).alias(name)
    return col(name)


def _summed(df: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    if not keys or not targets:
        return df
    return df.groupBy(*[clean_key(df, key) for key in keys]).agg(
        *[clean_sum(df, target) for target in targets]
    )


def rollup_technology(
    df: DataFrame, roles: Roles = Roles(), time_columns: Sequence[str] | None = None
) -> DataFrame:
    """Sum units to technologies.

    Keys are run, technology, property, area, sample and scenario, as far as
    present, and all time columns (detected when not given, which may start a
    job). Null is a key like any other. All other numeric columns are summed;
    all other columns disappear. Without a technology column, or without
    anything to sum, the frame is returned as it is.
    """
    if roles.technology not in df.columns:
        return df
    if time_columns is None:
        time_columns = detect_time_columns(df, roles)
    names = [
        roles.run,
        roles.technology,
        roles.prop,
        roles.area,
        roles.sample,
        roles.ws,
        *time_columns,
    ]
    keys = [name for name in dict.fromkeys(names) if name in df.columns]
    return _summed(df, keys, _targets(df, keys, roles))


def collapse_units(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Sum over units and keep every other column that is no measurement.

    Needs a technology and a unit column, else the frame is returned as it is.
    Dimensions stay keys also when they are numbers.
    """
    if roles.technology not in df.columns or roles.unit not in df.columns:
        return df
    numbers = set(numeric_columns(df))
    keys = [
        name
        for name in df.columns
        if name != roles.unit and (name not in numbers or name in roles.dimensions)
    ]
    return _summed(df, keys, _targets(df, keys, roles))


def rollup_cluster(df: DataFrame, cluster: str, roles: Roles = Roles()) -> DataFrame:
    """Sum technologies to the clusters named in column ``cluster``."""
    names = [
        roles.run, cluster, roles.prop, roles.area, roles.sample, roles.ws, roles.time
    ]
    keys = [name for name in names if name in df.columns]
    return _summed(df, keys, _targets(df, keys, roles))


def _targets(df: DataFrame, keys: Sequence[str], roles: Roles) -> list[str]:
    taken = {*keys, *roles.dimensions}
    return [name for name in numeric_columns(df) if name not in taken]
