"""Evaluation of a trace list: from facts to one series per trace."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.time import BUCKETS, bucket_end_by, bucket_start_by, within_dates
from tracemill.functions.values import nan_to_null, sum_or_zero
from tracemill.operators.joins import may_broadcast, spread_join
from tracemill.operators.match import Selection, match, selection_of, selections_of
from tracemill.operators.profile import time_columns_by_name
from tracemill.operators.rollup import clean_key
from tracemill.plans.traces import RAW, TraceSpec, specs_frame, trace_label
from tracemill.roles import Roles, col
from tracemill.session import durable, rows_frame

AGGREGATES = {"sum": sum_or_zero, "mean": F.avg, "min": F.min, "max": F.max}

TRACES = "trace_id int, selection_id int, function string, resolution string"
# A trace in the list of traces, as a row.
TRACE_BYTES = 100
POINTS = "trace_id int, resolution string, time timestamp_ntz, value double"


@dataclass(frozen=True)
class Evaluation:
    """The points of all traces, and what is needed to report on them.

    ``points`` has ``trace_id, resolution, time, value``; a trace is known by
    its place in ``specs``. ``refused`` has ``trace_id, rows`` for raw traces
    that are too large.
    """

    points: DataFrame
    refused: DataFrame
    specs: tuple[TraceSpec, ...]


def matched_rows(
    facts: DataFrame,
    selections: dict[Selection, int],
    roles: Roles = Roles(),
    unit_detail: bool = False,
    start: str | None = None,
    end: str | None = None,
    time_columns: Sequence[str] | None = None,
) -> DataFrame:
    """``selection_id, time, value`` of the rows that the selections ask for.

    ``facts`` is a table as made by ``clean.fact_table``. Without unit detail,
    units are first summed to the technology, for each time and each other
    dimension and time column: a daily mean is then the mean of technology
    totals. Only matched rows are summed.
    """
    inside = facts.where(within_dates(col(roles.time), start, end))
    rows = match(inside, selections, roles)
    value = nan_to_null(col(roles.value).cast("double"))
    if rolls_up(facts, roles, unit_detail):
        names = (
            roles.run,
            roles.technology,
            roles.prop,
            roles.area,
            roles.sample,
            roles.ws,
            roles.time,
            *(time_columns_by_name(rows) if time_columns is None else time_columns),
        )
        keys = [clean_key(rows, name) for name in dict.fromkeys(names) if name in rows.columns]
        rows = rows.groupBy("selection_id", *keys).agg(sum_or_zero(value).alias("__value"))
        value = F.col("__value")
    return rows.select("selection_id", col(roles.time).alias("time"), value.alias("value"))


def rolls_up(facts: DataFrame, roles: Roles, unit_detail: bool) -> bool:
    return not unit_detail and roles.technology in facts.columns


def evaluate(
    facts: DataFrame,
    specs: Sequence[TraceSpec],
    roles: Roles = Roles(),
    unit_detail: bool = False,
    start: str | None = None,
    end: str | None = None,
    raw_limit: int | None = None,
    time_columns: Sequence[str] | None = None,
) -> Evaluation:
    """Evaluate all traces over ``facts``.

    One pass over the facts serves every aggregated trace: traces that share a
    selection and a bucket share the sums, and each then takes its own function.
    A list of nothing but sums needs no roll-up, since a sum of sums is the sum;
    its only shuffle is that of the buckets. Raw traces take a pass of their own.
    With ``raw_limit``, a raw trace of more rows is refused as a whole; this starts
    the job that finds the raw points and writes them to the shared folder.
    ``time_columns`` are further keys of the roll-up, by default all columns
    whose names say so; ``profile.detect_time_columns`` also looks at contents.
    """
    spark = facts.sparkSession
    plain = [spec.normalized() for spec in specs]
    if rolls_up(facts, roles, unit_detail):
        # Units are gone after the roll-up, so a trace cannot pick one.
        plain = [replace(spec, unit=None) for spec in plain]
    numbers = selections_of(plain, facts.columns, roles)
    points = rows_frame(spark, [], POINTS)
    refused = rows_frame(spark, [], "trace_id int, rows bigint")

    def rows_for(traces: list[tuple]) -> DataFrame:
        used = {number for _, number, _, _ in traces}
        chosen = {s: number for s, number in numbers.items() if number in used}
        single = unit_detail or all(function == "sum" for _, _, function, _ in traces)
        return matched_rows(facts, chosen, roles, single, start, end, time_columns)

    traces = [
        (i, numbers[selection_of(spec, facts.columns, roles)], spec.function, spec.bucket)
        for i, spec in enumerate(plain)
    ]
    summed = [trace for trace in traces if trace[2] != RAW]
    raw = [trace for trace in traces if trace[2] == RAW]
    parts = []
    if summed:
        parts.append(_aggregated(rows_for(summed), summed))
    if raw:
        rows, refused = _raw(rows_for(raw), raw, raw_limit)
        parts.append(rows)
    if parts:
        points = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Evaluation(points, refused, tuple(specs))


def _aggregated(rows: DataFrame, traces: list[tuple]) -> DataFrame:
    spark = rows.sparkSession
    resolutions = sorted({resolution for _, _, _, resolution in traces})
    pairs = sorted({(selection, resolution) for _, selection, _, resolution in traces})
    functions = sorted({function for _, _, function, _ in traces})

    asked = rows_frame(spark, pairs, "selection_id int, resolution string")
    start = bucket_start_by("time", "resolution", resolutions)
    rows = _for_traces(rows, asked, len(pairs))
    sums = rows.groupBy("selection_id", "resolution", start.alias("time")).agg(
        *[AGGREGATES[name](F.col("value")).alias(name) for name in functions]
    )
    cases = " ".join(f"when '{name}' then `{name}`" for name in functions)
    wanted = rows_frame(spark, traces, TRACES)
    return sums.join(wanted, ["selection_id", "resolution"]).select(
        "trace_id", "resolution", "time", F.expr(f"case function {cases} end").alias("value")
    )


def _raw(
    rows: DataFrame, traces: list[tuple], limit: int | None
) -> tuple[DataFrame, DataFrame]:
    spark = rows.sparkSession
    wanted = rows_frame(spark, traces, TRACES)
    points = _for_traces(rows, wanted, len(traces)).select("trace_id", "resolution", "time", "value")
    if limit is None:
        return points, rows_frame(spark, [], "trace_id int, rows bigint")
    points = durable(points)
    sizes = points.groupBy("trace_id").agg(F.count(F.lit(1)).alias("rows"))
    # The traces refused are some of the list that came from the driver.
    refused = rows_frame(
        spark, sizes.where(F.col("rows") > limit).collect(), "trace_id int, rows bigint"
    )
    return points.join(refused, "trace_id", "left_anti"), refused


def _for_traces(rows: DataFrame, traces: DataFrame, length: int) -> DataFrame:
    """Matched rows, once for each row of a trace list with their selection.

    A list within the bound is broadcast; for a longer one the rows of a selection,
    which may be most of the facts, are split by their time.
    """
    if may_broadcast(length, TRACE_BYTES):
        return rows.join(F.broadcast(traces), "selection_id")
    return spread_join(rows, traces, ["selection_id"], ["time"])


def with_steps(points: DataFrame) -> DataFrame:
    """Two points per bucket, at its start and its last microsecond.

    Points that are in no bucket stay as they are.
    """
    bucketed = F.col("resolution").isin(*BUCKETS)
    both = F.array(F.col("time"), bucket_end_by("time", "resolution"))
    times = F.when(bucketed, both).otherwise(F.array("time"))
    return points.select("trace_id", "resolution", F.explode(times).alias("time"), "value")


def report(result: Evaluation, points: DataFrame, need_values: bool = False) -> DataFrame:
    """Per trace: label, number of points, and ``ok``, ``missing`` or ``too_large``.

    ``points`` are the points to count, such as ``with_steps(result.points)``.
    With ``need_values`` a trace is also missing when all its values are null,
    as it is for a density.
    """
    labels = specs_frame(points.sparkSession, result.specs)
    seen = F.count("value") if need_values else F.count(F.lit(1))
    counts = points.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("points"), (seen > 0).alias("seen")
    )
    status = (
        F.when(F.col("rows").isNotNull(), "too_large")
        .when(F.coalesce("seen", F.lit(False)), "ok")
        .otherwise("missing")
    )
    return (
        labels.join(counts, "trace_id", "left")
        .join(result.refused, "trace_id", "left")
        .select(
            "trace_id",
            trace_label().alias("label"),
            F.coalesce("points", F.lit(0)).alias("points"),
            status.alias("status"),
        )
    )


def summary(reported: DataFrame) -> DataFrame:
    """One row: traces, points in total, and the labels without data in list order."""
    absent = F.when(F.col("status") == "missing", F.struct("trace_id", "label"))
    first = F.array_sort(F.collect_list(absent))
    return reported.agg(
        F.count(F.lit(1)).alias("traces"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.transform(first, lambda entry: entry["label"]).alias("missing"),
    )
