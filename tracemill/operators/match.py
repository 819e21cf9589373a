"""Which fact rows belong to which traces, in one pass over the facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.plans.traces import TraceSpec, as_number
from tracemill.roles import Roles, col
from tracemill.session import rows_frame


@dataclass(frozen=True)
class Selection:
    """The row filter of one or more traces."""

    run: str | None
    source: str | None
    scenario: str | None
    ws: str
    ws_number: float | None
    area: str
    prop: str | None
    technology: str | None
    unit: str | None


SELECTION_SCHEMA = (
    "selection_id int, __s_run string, __s_source string, __s_scenario string, __s_ws string,"
    " __s_ws_number double, __s_area string, __s_prop string, __s_technology string,"
    " __s_unit string"
)


def selection_of(spec: TraceSpec, columns: Sequence[str], roles: Roles = Roles()) -> Selection:
    """The row filter of a trace over facts with the given columns.

    A trace with a run is filtered by it; where the facts have no run column, or
    the trace no run, by its scenario: by the source file if it looks like a path
    and the facts name their files, else by the scenario column. A run that the
    facts cannot tell, without a scenario, is an error.
    """
    def text(value):
        return None if value is None else str(value)

    loose = spec.run is None or roles.run not in columns
    if loose and spec.run is not None and spec.scenario is None:
        raise ValueError(f"column {roles.run!r} is needed to match run {spec.run!r}")
    by_file = loose and spec.looks_like_path and roles.source in columns
    return Selection(
        run=None if loose else text(spec.run),
        source=spec.scenario if by_file else None,
        scenario=text(spec.scenario) if loose and not by_file else None,
        ws=str(spec.ws),
        ws_number=as_number(spec.ws),
        area=str(spec.area),
        prop=text(spec.prop),
        technology=text(spec.technology),
        unit=text(spec.unit),
    )


def selections_of(
    specs: Sequence[TraceSpec], columns: Sequence[str], roles: Roles = Roles()
) -> dict[Selection, int]:
    """Distinct row filters of the traces, numbered in list order."""
    found: dict[Selection, int] = {}
    for spec in specs:
        found.setdefault(selection_of(spec, columns, roles), len(found))
    return found


def selections_frame(spark: SparkSession, selections: dict[Selection, int]) -> DataFrame:
    rows = [
        (
            number, s.run, s.source, s.scenario, s.ws, s.ws_number, s.area,
            s.prop, s.technology, s.unit,
        )
        for s, number in selections.items()
    ]
    return rows_frame(spark, rows, SELECTION_SCHEMA)


def scenario_column(df: DataFrame, roles: Roles = Roles()) -> str | None:
    """The column that traces without a run compare their scenario with.

    The source file if it is filled, else the first of the scenario and sample
    columns with any value. Starts a job that stops at the first value found.
    """
    for name in (roles.source, roles.scenario, roles.sample):
        if name in df.columns and not df.select(col(name)).where(col(name).isNotNull()).isEmpty():
            return name
    return roles.source if roles.source in df.columns else None


def match(
    facts: DataFrame,
    selections: dict[Selection, int],
    roles: Roles = Roles(),
) -> DataFrame:
    """Fact rows with the ``selection_id`` they belong to.

    A row that several selections ask for appears once for each. The selections
    are part of the plan, so Spark knows their size and broadcasts them if it may; a
    longer list is joined by shuffle, where Spark splits large partitions. The values asked for also go to the scan as filters, so that
    row groups and files of other runs are skipped.
    """
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    for name in (roles.area, roles.ws):
        if name not in kinds:
            raise ValueError(f"column {name!r} is needed to match traces")
    facts = _scan_filter(facts, list(selections), kinds, roles)

    # Specs are cast to the type of the column, never the column to text, so
    # that comparisons stay on stored values.
    wanted = selections_frame(facts.sparkSession, selections)
    on: list[Column] = []
    if isinstance(kinds[roles.ws], T.NumericType):
        on.append(col(roles.ws).cast("double") == F.col("__s_ws_number"))
    else:
        text = col(roles.ws).cast("string")
        fact_key = F.coalesce(text.try_cast("double").cast("string"), text)
        on.append(fact_key == F.coalesce(F.col("__s_ws_number").cast("string"), F.col("__s_ws")))
    on.append(col(roles.area) == F.col("__s_area").try_cast(kinds[roles.area]))

    optional = [
        (roles.run, "run"),
        (roles.source, "source"),
        (roles.prop, "prop"),
        (roles.technology, "technology"),
        (roles.unit, "unit"),
    ]
    if any(s.scenario is not None for s in selections):
        column = scenario_column(facts, roles)
        if column is None:
            raise ValueError("a column of scenarios is needed to match traces without a run")
        optional.append((column, "scenario"))
    for name, field in optional:
        asked = [getattr(s, field) is not None for s in selections]
        if name not in kinds or not any(asked):
            continue
        target = F.col(f"__s_{field}")
        same = col(name) == target.try_cast(kinds[name])
        on.append(same if all(asked) else target.isNull() | same)

    condition = reduce(lambda a, b: a & b, on)
    columns = [col(name) for name in facts.columns]
    return facts.join(wanted, condition).select("selection_id", *columns)


def _scan_filter(
    facts: DataFrame,
    selections: Sequence[Selection],
    kinds: dict[str, T.DataType],
    roles: Roles,
) -> DataFrame:
    """Filter on the values that the selections ask for, where all name one.

    Long lists reach the scan as their smallest and largest value, by Spark itself.
    """
    for name, field in (
        (roles.run, "run"),
        (roles.area, "area"),
        (roles.prop, "prop"),
        (roles.technology, "technology"),
        (roles.unit, "unit"),
    ):
        values = {getattr(s, field) for s in selections}
        if name not in kinds or None in values or not values:
            continue
        if isinstance(kinds[name], T.StringType):
            facts = facts.where(col(name).isin(sorted(values)))
    numbers = {s.ws_number for s in selections}
    if isinstance(kinds[roles.ws], T.NumericType) and None not in numbers and numbers:
        facts = facts.where(col(roles.ws).isin(sorted(numbers)))
    return facts
