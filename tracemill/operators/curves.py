"""Curves of whole series: duration, density, stacked area, line.

A single series may hold most of the rows, and a single value most of a series.
No step gathers a series, or the copies of a value, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.values import sum_or_zero, to_number
from tracemill.operators.joins import lookup_join
from tracemill.roles import col, quoted
from tracemill.session import durable

# Rows that one input row may turn into within a task; more copies of a value
# are spread over tasks.
COPIES_PER_ROW = 10_000

# A series' name, range and count as a row.
SHAPE_BYTES = 200

# Numbers of bins of a density.
BINS = 100
MIN_BINS = 10


def duration_curve(points: DataFrame, series: str = "trace_id", value: str = "value") -> DataFrame:
    """Values of each series in descending order over their share of the count.

    Columns: series, ``rank`` from 1, ``x`` = rank / count * 100, and the value.
    Nulls come last and count. Starts jobs, see ``value_ranges``.
    """
    curve = _curve(points.select(col(series).alias("s"), col(value).alias("v")))
    return curve.select(
        F.col("s").alias(series), "rank", _percent().alias("x"), F.col("v").alias(value)
    )


def duration_curve_frame(df: DataFrame, series: str, value: str) -> DataFrame:
    """Duration curve of any column: what is no number is left out first."""
    number = to_number(col(value), df.schema[value].dataType)
    values = df.select(col(series).alias("s"), number.alias("v")).where("v is not null")
    return _curve(values).select(
        F.col("s").alias(series),
        F.col("v").alias(value),
        "rank",
        _percent().alias("duration_percent"),
    )


def _percent() -> Column:
    return F.col("rank") / F.col("n") * 100.0


def _curve(points: DataFrame) -> DataFrame:
    """One row per point ``s, v`` with its ``rank`` in the series and its count ``n``."""
    ranges = value_ranges(points)
    most = ranges.agg(F.max("copies")).first()[0] or 0
    runs = first_ranks(ranges).selectExpr("s", "v", "n", "first", "first + copies - 1 as last")
    step = 1
    while most > step * COPIES_PER_ROW:
        step *= COPIES_PER_ROW
    while step > 1:
        runs = _split(runs, step).repartition("s", "first")
        step //= COPIES_PER_ROW
    return _split(runs, 1).withColumnRenamed("first", "rank")


def _split(runs: DataFrame, step: int) -> DataFrame:
    """Cut each run of ranks ``first .. last`` into runs of at most ``step``."""
    pieces = runs.withColumn("first", F.expr(f"explode(sequence(first, last, {step}L))"))
    return pieces.withColumn("last", F.expr(f"least(first + {step - 1}, last)"))


def value_ranges(points: DataFrame) -> DataFrame:
    """Distinct values ``v`` of each series ``s`` with their ``copies``, cut into ranges.

    Equal values are counted before the shuffle; the distinct values then go to
    ranges of about equal size that follow (series, value descending). The
    ranges are written to the shared folder, so that every later step sees the
    same ones. Starts a job.
    """
    tied = points.where("s is not null").groupBy("s", "v").agg(F.count(F.lit(1)).alias("copies"))
    ordered = tied.repartitionByRange(F.col("s"), F.col("v").desc_nulls_last())
    return durable(ordered.withColumn("range", F.spark_partition_id()))


def first_ranks(ranges: DataFrame) -> DataFrame:
    """Add the ``first`` rank of each distinct value, and the series' count ``n``.

    The rank is the running count inside the range plus the count of the ranges
    before it. The work per task is one range, never a series.
    """
    sizes = ranges.groupBy("s", "range").agg(F.sum("copies").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("s").orderBy("range")) - F.col("size")
    whole = F.sum("size").over(Window.partitionBy("s"))
    starts = sizes.select("s", "range", earlier.alias("earlier"), whole.alias("n"))
    inside = Window.partitionBy("s", "range").orderBy(F.col("v").desc_nulls_last())
    upto = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranges.withColumn("upto", upto)
        .join(starts, ["s", "range"])
        .selectExpr("s", "v", "copies", "n", "earlier + upto - copies + 1 as first")
    )


def density(points: DataFrame, series: str = "trace_id", value: str = "value") -> DataFrame:
    """Histogram of each series as a density over equal bins.

    Columns: series, ``bin`` from 0, ``x`` = centre of the bin, ``y``. There are
    100 bins, or fewer (at least 10) for fewer values. Nulls and infinite values
    are left out; a series without values has no rows, nor has one without a
    name, as for a duration curve. A series of one value gets the range around it.
    The last bin holds its right edge.

    Two passes over the points: the first finds the range and count of each
    series and is a job of its own, the second counts by bin before it shuffles.
    """
    number = to_number(col(value), points.schema[value].dataType)
    values = points.select(col(series).alias("s"), number.alias("v")).where(
        "s is not null and v is not null and abs(v) < double('Infinity')"
    )
    shape = durable(
        values.groupBy("s")
        .agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"))
        .selectExpr(
            "s",
            "n",
            "if(least = most, least - 0.5D, least) as low",
            "if(least = most, most + 0.5D, most) as high",
            f"cast(least({BINS}, greatest({MIN_BINS}, n)) as int) as bins",
        )
        .withColumn("width", F.expr("(high - low) / bins"))
    )
    # Division alone puts some values that lie on an edge into the wrong bin, so
    # the bin is then moved to where the edges say.
    guess = "least(cast(floor((v - low) / (high - low) * bins) as int), bins - 1) as guess"
    inside = (
        lookup_join(values, shape, ["s"], ["v"], SHAPE_BYTES)
        .selectExpr("*", guess)
        .selectExpr(
            "s",
            f"""case when v < {_edge("guess")} then guess - 1
                when guess < bins - 1 and v >= {_edge("guess + 1")} then guess + 1
                else guess end as bin""",
        )
        .groupBy("s", "bin")
        .agg(F.count(F.lit(1)).alias("inside"))
    )
    # At most 100 bins per series, empty ones included.
    bins = shape.withColumn("bin", F.expr("explode(sequence(0, bins - 1))"))
    left, right = _edge("bin"), _edge("bin + 1")
    return bins.join(inside, ["s", "bin"], "left").selectExpr(
        f"s as {quoted(series)}",
        "bin",
        f"({left} + {right}) / 2 as x",
        f"coalesce(inside, 0) / ({right} - {left}) / n as y",
    )


def _edge(number: str) -> str:
    """Left edge of a bin; the edge after the last bin is the maximum itself."""
    return f"if({number} = bins, high, ({number}) * width + low)"


def stacked_area(points: DataFrame, trace_ids: Sequence[int]) -> DataFrame:
    """Traces stacked on each other in list order, at each time.

    Columns ``trace_id, time, value, y0, y1``. A trace without a point at a time
    is 0 there, so there is a row for every time and every trace that has any
    point; a trace without points is no layer. Values of one trace at one time
    are added. Starts a job that sums up the points. Rows of a time meet in one
    task, as many as there are traces.
    """
    cells = durable(
        points.groupBy("time", "trace_id").agg(sum_or_zero(F.col("value")).alias("value"))
    )
    known = {row["trace_id"] for row in cells.select("trace_id").distinct().collect()}
    present = [i for i in dict.fromkeys(int(i) for i in trace_ids) if i in known]
    ids = F.array(*map(F.lit, present)).cast(f"array<{cells.schema['trace_id'].dataType.simpleString()}>")
    filler = (
        cells.select("time")
        .distinct()
        .select("time", F.explode(ids).alias("trace_id"), F.lit(0.0).alias("value"))
    )
    own = cells.where(F.col("trace_id").isin(present)) if present else cells.limit(0)
    grid = (
        own.select("time", "trace_id", F.col("value").cast("double").alias("value"))
        .unionByName(filler)
        .repartition("time")
        .groupBy("time", "trace_id")
        .agg(F.sum("value").alias("value"))
    )
    stack = Window.partitionBy("time").orderBy("trace_id")
    below = F.sum("value").over(stack.rowsBetween(Window.unboundedPreceding, -1))
    upto = F.sum("value").over(stack.rowsBetween(Window.unboundedPreceding, 0))
    return grid.select(
        "trace_id", "time", "value", F.coalesce(below, F.lit(0.0)).alias("y0"), upto.alias("y1")
    )


def line(points: DataFrame, series: str = "trace_id", time: str = "time") -> DataFrame:
    """Points in list order of the traces and in order of time.

    The other columns are last in the order, so that the many rows which a raw
    trace may have at one time are still cut into several ranges.
    """
    rest = [name for name in points.columns if name not in (series, time)]
    return points.orderBy(*map(col, [series, time, *rest]))


def first_technology(df: DataFrame, series: str, technology: str, order: str) -> DataFrame:
    """First non-null technology of each series in the order of a column."""
    first = F.min(F.struct(col(order).alias("o"), col(technology).alias("t")))
    known = df.where(col(technology).isNotNull())
    return (
        known.groupBy(col(series))
        .agg(first.alias("first"))
        .select(col(series), F.col("first.t").alias("technology"))
    )
