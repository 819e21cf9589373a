"""Cleaning of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what counts as a number in a text. Spark alone would also read
# "5d" and "5f" as numbers.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def to_number(value: Column, kind: T.DataType) -> Column:
    """``value`` as double; texts that are no number, and NaN, become null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return nan_to_null(value.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def is_meaningful(value: Column, kind: T.DataType) -> Column:
    """Not null, not NaN and not blank."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.isNotNull() & ~F.isnan(value)
    if isinstance(kind, T.StringType):
        return value.isNotNull() & value.rlike(r"(?U)\S")
    return value.isNotNull()


def sum_or_zero(value: Column) -> Column:
    """Sum in which a group of nulls only gives 0."""
    return F.coalesce(F.sum(value), F.lit(0))
