"""Parsing of time texts, and time buckets.

Times are ``timestamp_ntz``: naive wall-clock times. The session time zone is
expected to be UTC (see ``tracemill.session.configure``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# The resolutions that put times into buckets.
BUCKETS = ("hour", "day", "week", "month")

# Layouts of time texts. ``hint`` is the layout of the model
# outputs; the others are tried when the hint fits too few rows, and of equals the
# first counts. One layout is used for a whole column.
HINT = "hint"
ISO = "iso"
CLOCK = "[ H:m[:s[.SSSSSS]]]"
HALF_DAY = " h:m[:s] a"
LAYOUTS = {
    HINT: "yyyy-M-d H.m",
    ISO: None,
    "compact": "yyyyMMdd",
    "slash_year_first": f"yyyy/M/d{CLOCK}",
    "slash_month_first": f"M/d/yyyy{CLOCK}",
    "slash_day_first": f"d/M/yyyy{CLOCK}",
    "dot_month_first": f"M.d.yyyy{CLOCK}",
    "dot_day_first": f"d.M.yyyy{CLOCK}",
    "dot_year_first": f"yyyy.M.d{CLOCK}",
    "dash_month_first": f"M-d-yyyy{CLOCK}",
    "dash_day_first": f"d-M-yyyy{CLOCK}",
    "dash_year_first": f"yyyy-M-d{CLOCK}",
    "month_name": f"d MMM yyyy{CLOCK}",
    "month_name_long": f"d MMMM yyyy{CLOCK}",
    "month_name_first": f"MMM d, yyyy{CLOCK}",
    "month_name_dashed": f"d-MMM-yyyy{CLOCK}",
    "half_days_dash": f"yyyy-M-d{HALF_DAY}",
    "half_days_slash_month_first": f"M/d/yyyy{HALF_DAY}",
    "half_days_slash_day_first": f"d/M/yyyy{HALF_DAY}",
}


def parse_time(text: Column, layout: str) -> Column:
    """Read a text column in one layout; texts that do not fit become null."""
    pattern = LAYOUTS[layout]
    if pattern is None:
        return text.try_cast(NTZ)
    return F.try_to_timestamp(text, F.lit(pattern)).cast(NTZ)


# Start of the bucket that holds a time, and its length. Weeks run
# from Tuesday to Monday. Dates carry no zone, so days, weeks and months are
# floored as dates.
_START = {
    "hour": "cast(cast({t} as date) as timestamp_ntz) + make_dt_interval(0, hour({t}))",
    "day": "cast(cast({t} as date) as timestamp_ntz)",
    "week": "cast(date_sub(next_day(cast({t} as date), 'TUE'), 7) as timestamp_ntz)",
    "month": "cast(trunc(cast({t} as date), 'month') as timestamp_ntz)",
}
_NEXT = {
    "hour": "{t} + interval 1 hour",
    "day": "{t} + interval 1 day",
    "week": "{t} + interval 7 days",
    "month": "cast(add_months(cast({t} as date), 1) as timestamp_ntz)",
}
_INSTANT = "interval '0.000001' second"


def bucket_start(time: str, resolution: str) -> Column:
    """Start of the bucket that holds the times of a column.

    ``resolution`` is the name of a bucket; any other keeps the time.
    """
    return F.expr(_START.get(resolution, "{t}").format(t=time))


def bucket_end(start: str, resolution: str) -> Column:
    """Last microsecond of the bucket that begins at the time in a column."""
    if resolution not in _NEXT:
        return F.expr(start)
    return F.expr(f"{_NEXT[resolution].format(t=start)} - {_INSTANT}")


def bucket_start_by(time: str, resolution: str, names: Sequence[str] = BUCKETS) -> Column:
    """Start of the bucket whose name is in the column ``resolution``."""
    return _by(time, resolution, {name: _START[name] for name in names if name in _START})


def bucket_end_by(start: str, resolution: str) -> Column:
    """Last microsecond of the bucket whose name is in ``resolution``."""
    return _by(start, resolution, {name: f"{_NEXT[name]} - {_INSTANT}" for name in BUCKETS})


def _by(time: str, resolution: str, forms: dict[str, str]) -> Column:
    if not forms:
        return F.expr(time)
    cases = " ".join(f"when '{name}' then {form.format(t=time)}" for name, form in forms.items())
    return F.expr(f"case {resolution} {cases} else {time} end")


def within_dates(time: Column, start: str | None, end: str | None) -> Column:
    """True from the start of day ``start`` to the end of day ``end``.

    A bound that is missing or is no date does not limit.
    """
    keep = F.lit(True)
    if start:
        first = F.lit(start).try_cast(NTZ)
        keep = keep & (first.isNull() | (time >= first))
    if end:
        last = F.lit(end).try_cast(NTZ)
        keep = keep & (last.isNull() | (time < last + F.expr("interval 1 day")))
    return keep
