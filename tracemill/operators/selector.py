"""Selector index: which combinations of dimensions the facts hold."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.values import is_meaningful
from tracemill.roles import Roles, col
from tracemill.session import durable, rows_frame


def selector_index(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Distinct combinations of the dimensions that ``df`` has.

    Spark drops duplicates within each task before the shuffle, so what moves
    is the index, not the facts.
    """
    present = [name for name in roles.dimensions if name in df.columns]
    if not present:
        empty = ", ".join(f"`{name}` string" for name in roles.dimensions)
        return rows_frame(df.sparkSession, [], empty)
    return df.select(*map(col, present)).distinct()


def selector_tree(index: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The selector hierarchy, one row per choice.

    Columns ``run, ws, area, property, technology``. A property without
    technology has a row with a null technology; a property may appear both
    with and without. Each run, scenario and area that the index knows has at
    least one row, with a null property when there is nothing to choose. Rows
    instead of nested sets: no group is ever gathered in one place.
    """
    needed = (roles.run, roles.area, roles.ws)
    kinds = {f.name: f.dataType for f in index.schema.fields}
    if any(name not in kinds for name in needed):
        return rows_frame(
            index.sparkSession, [], "run string, ws string, area string, property string, technology string"
        )

    def if_meaningful(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        return F.when(is_meaningful(col(name), kinds[name]), col(name))

    def not_null(name: str) -> Column:
        known = col(name).isNotNull()
        if isinstance(kinds[name], (T.FloatType, T.DoubleType)):
            known = known & ~F.isnan(col(name))
        return known

    prop, tech = if_meaningful(roles.prop), if_meaningful(roles.technology)
    return (
        index.where(not_null(roles.run) & not_null(roles.ws) & not_null(roles.area))
        .select(
            col(roles.run).alias("run"),
            col(roles.ws).alias("ws"),
            col(roles.area).alias("area"),
            prop.alias("property"),
            F.when(prop.isNotNull(), tech).alias("technology"),
        )
        .distinct()
    )


def same_text(column: Column, value: Any) -> Column:
    return column.cast("string") == F.lit(str(value))


def same_scenario(column: Column, kind: T.DataType, value: Any) -> Column:
    """Weather scenarios are equal as numbers, or as texts if no number."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return same_text(column, value)
    if isinstance(kind, T.NumericType):
        return column == F.lit(number)
    return column.try_cast("double") == F.lit(number)


def tree_leaf(tree: DataFrame, run: Any, ws: Any, area: Any) -> DataFrame:
    """The properties and technologies of one run, scenario and area."""
    return tree.where(
        same_text(F.col("run"), run)
        & same_scenario(F.col("ws"), tree.schema["ws"].dataType, ws)
        & same_text(F.col("area"), area)
        & F.col("property").isNotNull()
    ).select("property", "technology")


def leaf_properties(leaf: DataFrame) -> DataFrame:
    """Every property of a leaf, and whether it needs a technology.

    A property that has technologies needs one, also when it appears without.
    """
    return leaf.groupBy("property").agg(
        (F.count("technology") > 0).alias("requires_technology")
    )


def leaf_technologies(leaf: DataFrame, prop: Any) -> DataFrame:
    """The technologies of one property."""
    return (
        leaf.where(same_text(F.col("property"), prop) & F.col("technology").isNotNull())
        .select("technology")
        .distinct()
    )


def property_choices(tree: DataFrame) -> DataFrame:
    """Every property of any leaf: those that stand alone and those with a technology."""
    alone = tree.where("technology is null").select("property")
    return alone.union(tree.where("technology is not null").select("property")).distinct()


def options_by_label(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values in the order of their text, with rank; the first ``limit``."""
    labelled = df.select(col(column).alias("value"), col(column).cast("string").alias("label"))
    return _ranked_options(labelled, F.col("label"), limit)


def options_by_value(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values in their own order, with rank; the first ``limit``."""
    labelled = df.select(col(column).alias("value"), col(column).cast("string").alias("label"))
    return _ranked_options(labelled, F.col("value"), limit)


def _ranked_options(labelled: DataFrame, order: Column, limit: int | None) -> DataFrame:
    """With a limit, Spark keeps the first rows of each task; else the values are cut
    into ranges, and a rank is the place in its range after all ranges before."""
    present = F.col("value").isNotNull()
    if isinstance(labelled.schema["value"].dataType, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan("value")
    values = labelled.where(present).distinct()
    if limit is not None:
        values = values.orderBy(order).limit(limit)
    ranges = durable(values.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    # As many rows as there are ranges.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return (
        ranges.withColumn("place", place)
        .join(starts, "range")
        .select((F.col("start") + F.col("place")).alias("rank"), "value", "label")
    )


def unit_options(
    index: DataFrame,
    run: Any,
    ws: Any,
    area: Any,
    prop: Any,
    technology: Any,
    roles: Roles = Roles(),
    limit: int | None = None,
) -> DataFrame:
    """Units under the given choices; a choice of ``None`` does not filter.

    Without a property there are no units.
    """
    kinds = {f.name: f.dataType for f in index.schema.fields}
    if prop is None or roles.unit not in kinds:
        return rows_frame(index.sparkSession, [], "rank bigint, value string, label string")
    found = index
    for name, value in (
        (roles.run, run),
        (roles.area, area),
        (roles.prop, prop),
        (roles.technology, technology),
    ):
        if value is not None and name in kinds:
            found = found.where(same_text(col(name), value))
    if ws is not None and roles.ws in kinds:
        found = found.where(same_scenario(col(roles.ws), kinds[roles.ws], ws))
    meaningful = is_meaningful(col(roles.unit), kinds[roles.unit])
    return options_by_label(found.where(meaningful), roles.unit, limit)


def keep_known(options: Sequence[str], chosen: Sequence[str] | None) -> list[str]:
    """The chosen options in list order; all options when none is known."""
    wanted = set(chosen or ())
    return [option for option in options if option in wanted] or list(options)


def membership_filter(df: DataFrame, column: str, values: Sequence[Any] | None) -> DataFrame:
    """Rows whose value is listed; all rows when the column or list is missing."""
    if column not in df.columns or not values:
        return df
    return df.where(col(column).isin(list(values)))


def series_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null labels, sorted without regard to case."""
    labels = df.select(col(column).cast("string").alias("label")).where("label is not null")
    return labels.distinct().orderBy(F.lower("label"), "label")
