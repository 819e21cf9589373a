"""Traces: what a user asks for, checked against the selector tree.

A trace picks rows by their dimensions, and says how to aggregate them in which
time bucket. Trace lists are typed in by people, so they are plain lists; the
facts never are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.time import BUCKETS
from tracemill.session import rows_frame

# The functions of a trace. ``none`` asks for the raw rows.
FUNCTIONS = ("sum", "mean", "min", "max")
RAW = "none"
NATIVE = "native"

SPEC_SCHEMA = (
    "trace_id int, run string, scenario string, ws string, ws_number double, area string,"
    " property string, technology string, unit string, aggregation string, resolution string"
)


@dataclass(frozen=True)
class TraceSpec:
    """One trace. A dimension that is ``None`` does not filter.

    ``scenario`` is used by traces without a run: the path of a source file,
    or a value of the first filled scenario column.
    """

    run: str | None
    ws: Any
    area: Any
    prop: Any = None
    technology: Any = None
    unit: Any = None
    aggregation: str | None = None
    resolution: str | None = None
    scenario: str | None = None
    is_technology: bool = False

    def normalized(self) -> TraceSpec:
        """Defaults filled in, and a technology trace written as such.

        Raw rows have no bucket. A trace marked ``is_technology`` names its
        technology in the ``prop`` field.
        """
        aggregation = self.aggregation or "sum"
        resolution = self.resolution or NATIVE
        spec = replace(
            self,
            run=self.run or None,
            aggregation=aggregation,
            resolution=NATIVE if aggregation == RAW else resolution,
        )
        if spec.is_technology:
            spec = replace(spec, technology=spec.prop, prop=None, is_technology=False)
        return spec

    @property
    def function(self) -> str:
        """The aggregate to compute: an unknown one is a sum."""
        known = (*FUNCTIONS, RAW)
        return self.aggregation if self.aggregation in known else FUNCTIONS[0]

    @property
    def bucket(self) -> str:
        """The bucket to use: an unknown one is the time itself."""
        return self.resolution if self.resolution in BUCKETS else NATIVE

    @property
    def looks_like_path(self) -> bool:
        text = self.scenario or ""
        return text.endswith(".parquet") or "/" in text or "\\" in text


def as_number(value: Any) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def specs_frame(spark: SparkSession, specs: Sequence[TraceSpec]) -> DataFrame:
    """The traces as rows, in list order, as they were given."""
    rows = [
        (
            i,
            _text(s.run),
            _text(s.scenario),
            _text(s.ws),
            as_number(s.ws),
            _text(s.area),
            _text(s.prop),
            _text(s.technology),
            _text(s.unit),
            s.aggregation,
            s.resolution,
        )
        for i, s in enumerate(specs)
    ]
    return rows_frame(spark, rows, SPEC_SCHEMA)


def trace_label() -> Column:
    """Label of a row of ``specs_frame``; it identifies the trace."""
    run = F.coalesce(F.nullif("run", F.lit("")), F.nullif("scenario", F.lit("")), F.lit("?"))
    base = F.concat_ws(
        " | ",
        run,
        F.concat(F.lit("WS "), F.coalesce("ws", F.lit("None"))),
        F.coalesce("area", F.lit("None")),
        "property",
        F.when(F.col("property").isNotNull(), F.col("technology")),
        F.nullif("unit", F.lit("")),
    )
    resolution = F.coalesce(F.nullif("resolution", F.lit("")), F.lit(NATIVE))
    how = (
        F.when(F.col("aggregation") == RAW, F.lit(" [raw]"))
        .when(F.coalesce("aggregation", F.lit("")) == "", F.lit(""))
        .otherwise(F.concat(F.lit(" ["), F.col("aggregation"), F.lit("/"), resolution, F.lit("]")))
    )
    return F.concat(base, how)


def with_defaults(specs: DataFrame) -> DataFrame:
    """Sum and native time where nothing is chosen; raw rows have no bucket."""
    aggregation = F.coalesce(F.nullif("aggregation", F.lit("")), F.lit(FUNCTIONS[0]))
    resolution = F.coalesce(F.nullif("resolution", F.lit("")), F.lit(NATIVE))
    return specs.withColumns(
        {
            "aggregation": aggregation,
            "resolution": F.when(aggregation == RAW, F.lit(NATIVE)).otherwise(resolution),
        }
    )


def validate(specs: DataFrame, tree: DataFrame, unit_detail: bool = False) -> DataFrame:
    """Add ``reason`` to each trace, null when the trace is valid.

    ``tree`` is the selector tree. It is cut to the traces' own properties
    before the join, which never has more rows than there are traces.
    """
    number = F.col("ws").try_cast("double")
    with_technology = tree.where(F.col("technology").isNotNull()).select(
        F.col("run").cast("string").alias("run"),
        F.coalesce(number.cast("string"), F.col("ws").cast("string")).alias("ws_key"),
        F.col("area").cast("string").alias("area"),
        F.col("property").cast("string").alias("property"),
    )
    keys = ["run", "ws_key", "area", "property"]
    specs = specs.withColumn("ws_key", F.coalesce(F.col("ws_number").cast("string"), "ws"))
    asked = specs.select(*keys).distinct()
    needing = (
        with_technology.join(asked, keys, "left_semi")
        .distinct()
        .withColumn("needs", F.lit(True))
    )
    needs = F.coalesce("needs", F.lit(False))
    incomplete = F.lit(False)
    for name in ("run", "area", "ws", "property"):
        incomplete = incomplete | F.col(name).isNull()
    reason = (
        F.when(incomplete, "incomplete")
        .when(needs & F.col("technology").isNull(), "technology_required")
        .when(~needs & F.col("technology").isNotNull(), "technology_not_allowed")
    )
    if unit_detail:
        reason = reason.when(~needs, "unit_needs_technology").when(
            F.col("unit").isNull(), "unit_required"
        )
    else:
        reason = reason.when(F.col("unit").isNotNull(), "unit_not_allowed")
    return (
        specs.join(needing, keys, "left")
        .withColumn("reason", reason)
        .drop("ws_key", "needs")
    )


def first_of_label(labelled: DataFrame) -> DataFrame:
    """Drop traces whose ``label`` an earlier trace has."""
    earlier = F.row_number().over(Window.partitionBy("label").orderBy("trace_id"))
    return labelled.withColumn("__place", earlier).where("__place = 1").drop("__place")


def without_labels(labelled: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Drop the traces with one of the given labels."""
    return labelled.where(~F.col("label").isin(list(labels))) if labels else labelled
