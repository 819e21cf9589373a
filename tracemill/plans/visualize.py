"""From run folders and a trace list to the frames behind a plot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.clean import fact_table
from tracemill.operators.curves import density, duration_curve, line, stacked_area
from tracemill.operators.selector import selector_index
from tracemill.plans.evaluate import evaluate, report, with_steps
from tracemill.plans.traces import TraceSpec
from tracemill.roles import Roles
from tracemill.session import durable
from tracemill.sources import discover_files, load_files, load_runs
from tracemill.sources.memory import remembered_readings

# The kinds of plot.
MODES = ("line", "stacked_area", "duration_curve", "density")


@dataclass(frozen=True)
class Plot:
    """``data``: what is drawn; ``report``: one row per trace."""

    data: DataFrame
    report: DataFrame


def load_facts(
    spark: SparkSession,
    root: str,
    specs: Sequence[TraceSpec],
    data_path: str | None = None,
    roles: Roles = Roles(),
    unit_detail: bool = False,
    memory: str | None = None,
) -> DataFrame:
    """The facts that the traces need, ready for ``evaluate``.

    Only the runs that traces name are listed and read; without any run, the
    files that traces name as scenarios; without those, everything. For unit
    detail the frame is cut to the columns that traces may ask for; otherwise
    other time columns matter too, and Spark itself reads only what is used. ``memory``
    is a folder in which the layouts of time texts are kept for later loads.
    """
    columns = [*roles.plot_columns, roles.unit] if unit_detail else None
    runs = sorted({spec.run for spec in specs if spec.run})
    if not runs:
        named = sorted({spec.scenario for spec in specs if spec.looks_like_path})
        files = discover_files(spark, root, None, data_path).where(F.col("path").isin(named))
        # At most one file per trace.
        paths = [row["path"] for row in files.select("path").collect()] if named else []
        if paths:
            return fact_table(load_files(spark, paths, root, columns, roles), roles)
    loaded = load_runs(spark, root, runs or None, columns, data_path, roles)
    readings = None
    if memory:
        readings = remembered_readings(
            spark, root, loaded, roles.time, memory, runs or None, data_path, roles
        )
    return fact_table(loaded, roles, readings=readings)


def load_index(
    spark: SparkSession,
    root: str,
    runs: str | Sequence[str] | None = None,
    data_path: str | None = None,
    roles: Roles = Roles(),
) -> DataFrame:
    """The selector index of the chosen runs, from their dimension columns."""
    loaded = load_runs(spark, root, runs, roles.dimensions, data_path, roles)
    return selector_index(loaded, roles)


def visualize(
    facts: DataFrame,
    specs: Sequence[TraceSpec],
    mode: str = "line",
    roles: Roles = Roles(),
    unit_detail: bool = False,
    start: str | None = None,
    end: str | None = None,
    raw_limit: int | None = None,
) -> Plot:
    """Evaluate the traces and shape their points for one kind of plot.

    The points are written to the shared folder once, because the plot and the
    report both need them: the facts are read once. Starts that job.
    """
    if mode not in MODES:
        raise ValueError(f"unknown kind of plot: {mode}")
    result = evaluate(facts, specs, roles, unit_detail, start, end, raw_limit)
    points = durable(with_steps(result.points))
    shapes = {
        "line": lambda: line(points),
        "stacked_area": lambda: stacked_area(points, range(len(specs))),
        "duration_curve": lambda: duration_curve(points),
        "density": lambda: density(points),
    }
    return Plot(shapes[mode](), report(result, points, need_values=mode == "density"))
