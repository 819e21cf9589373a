"""Layouts of time texts, from a histogram of their shapes.

A shape is what a text looks like: digits by the length of their run, names of months,
marks. A column of times has some tens of shapes, whatever its rows, so the histogram is
a sum in every task and a few rows after it. Beside its rows, a shape has counts of those
whose fields may be a day and a month in each order, and of those whose fields surely
are. That tells the orders apart, bounds what each known layout fits, and yields a
layout for texts that none of them fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.time import HINT, ISO, LAYOUTS, NTZ

# Names in time texts.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_LONG_MONTHS = (
    "january february march april june july august september october november december".split()
)
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

# Signs in shapes: short and long names of months, halves of the day, a fraction, the name
# of a day before the rest, runs of digits by their length. NOTHING is no time; ODD may be one, but of no shape known here.
SHORT, LONG, HALF, FRACTION, WEEKDAY = "@", "#", "%", "f", "~"
RUNS = {14: "S", 12: "I", 8: "D", 6: "X", 4: "Y"}
ONE_OR_TWO = "n"
NOTHING, ODD = "", "?"
MOST_SIGNS, MOST_RAW, MOST_LETTERS = 30, 45, 70

_WEEKDAY = "(?i)^(" + "|".join(f"{d[:3]}({d[3:]})?" for d in _DAYS) + r")[.,]? +"
_MAY_BE = r"(?i)^\s*([+-]?\d|" + "|".join(_MONTHS) + ")"


def without_weekday(text: Column) -> Column:
    return F.when(text.rlike(_WEEKDAY), F.regexp_replace(text, _WEEKDAY, "")).otherwise(text)


def raw_shape(text: Column) -> Column:
    """A text with names as signs and all digits as 0, if it may be a time; null stays null.

    What is done with every text; ``shape_of`` does the rest with what is left of them.
    """
    lettered = text.rlike("[A-Za-z]")
    plain = without_weekday(text)
    named = F.regexp_replace(plain, "(?i)(" + "|".join(_LONG_MONTHS) + ")(?![a-z])", LONG)
    named = F.regexp_replace(named, "(?i)(" + "|".join(_MONTHS) + ")(?![a-z])", SHORT)
    named = F.regexp_replace(named, r"(?i)(?<=[0-9 ])[ap]m$", HALF)
    signs = F.when(text.rlike(_WEEKDAY), F.concat(F.lit(WEEKDAY), _zeros(named))).otherwise(_zeros(named))
    known = plain.rlike("^[0-9A-Za-z ,./:-]*$") & ~named.rlike("[A-SU-Za-z]")
    with_names = F.when(known & (F.length(signs) <= MOST_RAW), signs).otherwise(ODD)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.length(text) > MOST_LETTERS, NOTHING)
        # What most columns of times have: digits and marks, told by one pattern.
        .when(
            text.rlike("^[0-9][0-9 ,./:-]*$"),
            F.when(F.length(text) <= MOST_RAW, _zeros(text)).otherwise(ODD),
        )
        .when(plain.rlike(_MAY_BE), F.when(lettered, with_names).otherwise(ODD))
        .otherwise(NOTHING)
    )


def _zeros(text: Column) -> Column:
    return F.translate(text, "123456789", "000000000")


def shape_of(raw: Column) -> Column:
    """The shape of a text by its ``raw_shape``: digits by the length of their run."""
    signs = F.regexp_replace(raw, "(?<=:0{1,2}[.,])0{1,6}(?!0)", FRACTION)
    for size, sign in RUNS.items():
        signs = F.regexp_replace(signs, f"(?<!0)0{{{size}}}(?!0)", sign)
    signs = F.regexp_replace(signs, "(?<!0)0{1,2}(?!0)", ONE_OR_TWO)
    allowed = f"^[{WEEKDAY}{SHORT}{LONG}{HALF}{FRACTION}{''.join(RUNS.values())}{ONE_OR_TWO}T ,./:-]+$"
    whole = signs.rlike(allowed) & (F.length(signs) <= MOST_SIGNS)
    return F.when(raw.isNull() | raw.isin(NOTHING, ODD), raw).when(whole, signs).otherwise(ODD)


def time_shape(text: Column) -> Column:
    """The shape of a text; null stays null."""
    return shape_of(raw_shape(text))


# Orders of a date's fields: which of the numbers in a text are its day and its month, and
# where the clock begins. With a name of a month there is no number for it.
ORDERS = {"ymd": (2, 1, 3), "dmy": (0, 1, 3), "mdy": (1, 0, 3), "named": (0, None, 2)}
_YEARS = {"ymd": 0, "dmy": 2, "mdy": 2, "named": 1}


def shape_counts(texts: DataFrame) -> DataFrame:
    """Per ``group`` and ``shape`` of ``text``: ``n``, and ``may_`` and ``sure_`` by order.

    One pass, and partial sums in every task: what is shuffled is shapes, not texts.
    """
    counted = _raw_counts(texts)
    names = [name for name in counted.columns if name not in ("group", "shape")]
    return counted.groupBy("group", "shape").agg(*[F.sum(name).alias(name) for name in names])


def _raw_counts(texts: DataFrame) -> DataFrame:
    """``shape_counts`` by raw shapes, of which some make one shape."""
    text, numbers = F.col("text"), F.col("numbers")
    read = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    rows = texts.select("group", raw_shape(text).alias("raw_shape"), "text")
    none = F.col("raw_shape").isNull() | F.col("raw_shape").isin(NOTHING, ODD)
    rows = rows.select(
        "group", "raw_shape", F.when(none, F.array().cast("array<int>")).otherwise(read).alias("numbers")
    )

    def at(place: int | None, low: int, high: int) -> Column:
        if place is None:
            return F.lit(True)
        return F.coalesce(F.get(numbers, F.lit(place)).between(low, high), F.lit(False))

    def clock(place: int) -> Column:
        told = zip(range(place, place + 3), (23, 59, 59))
        return F.array_min(F.array(*[F.coalesce(F.get(numbers, F.lit(i)) <= most, F.lit(True)) for i, most in told]))

    sums = []
    for order, (day, month, after) in ORDERS.items():
        may = at(day, 1, 31) & at(month, 1, 12)
        sure = at(day, 1, 28) & at(month, 1, 12) & at(_YEARS[order], 1, 9999) & clock(after)
        sums += [
            F.sum(F.when(may, 1).otherwise(0)).alias(f"may_{order}"),
            F.sum(F.when(sure, 1).otherwise(0)).alias(f"sure_{order}"),
        ]
    counted = rows.groupBy("group", "raw_shape").agg(F.count(F.lit(1)).alias("n"), *sums)
    return counted.withColumn("shape", shape_of(F.col("raw_shape"))).drop("raw_shape")


# The shapes that layouts read, and the order of their fields.
_CLOCK = r"( n:n(:n(\.f)?)?)?"
_HALF_DAY = rf" n:n(:n)? {HALF}"
_READS = {
    HINT: (r"Y-n-n n\.n", "ymd"),
    "slash_year_first": (f"Y/n/n{_CLOCK}", "ymd"),
    "slash_month_first": (f"n/n/Y{_CLOCK}", "mdy"),
    "slash_day_first": (f"n/n/Y{_CLOCK}", "dmy"),
    "dot_month_first": (rf"n\.n\.Y{_CLOCK}", "mdy"),
    "dot_day_first": (rf"n\.n\.Y{_CLOCK}", "dmy"),
    "dot_year_first": (rf"Y\.n\.n{_CLOCK}", "ymd"),
    "dash_month_first": (f"n-n-Y{_CLOCK}", "mdy"),
    "dash_day_first": (f"n-n-Y{_CLOCK}", "dmy"),
    "dash_year_first": (f"Y-n-n{_CLOCK}", "ymd"),
    "month_name": (f"n {SHORT} Y{_CLOCK}", "named"),
    "month_name_long": (f"n {LONG} Y{_CLOCK}", "named"),
    "month_name_first": (f"{SHORT} n, Y{_CLOCK}", "named"),
    "month_name_dashed": (f"n-{SHORT}-Y{_CLOCK}", "named"),
    "half_days_dash": (f"Y-n-n{_HALF_DAY}", "ymd"),
    "half_days_slash_month_first": (f"n/n/Y{_HALF_DAY}", "mdy"),
    "half_days_slash_day_first": (f"n/n/Y{_HALF_DAY}", "dmy"),
}
_ISO = r"Y-n-n([ T]n:n(:n(\.f)?)?)?"


@dataclass(frozen=True)
class Inferred:
    """A layout found from shapes: a pattern for each shape that the texts have."""

    patterns: tuple[str, ...]

    def parse(self, text: Column) -> Column:
        plain = without_weekday(text)
        return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in self.patterns]).cast(NTZ)


class AmbiguousTimes(ValueError):
    """Texts that are times in several orders of their fields, with different results."""


@dataclass
class Shapes:
    """The histogram of one group."""

    rows: list[dict] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(row["n"] for row in self.rows)

    @property
    def filled(self) -> int:
        return sum(row["n"] for row in self.rows if row["shape"] is not None)

    def most_times(self) -> int:
        """How many rows may be times in one layout or another, at most."""
        return sum(row["n"] for row in self.rows if row["shape"] not in (None, NOTHING))

    def fits(self, layout: str) -> tuple[int, int]:
        """How many rows a known layout reads: at least, and at most."""
        least = most = 0
        for row in self.rows:
            shape = row["shape"]
            if shape in (None, NOTHING):
                continue
            if shape == ODD:
                most += row["n"]
            elif layout == ISO:
                if re.fullmatch(_ISO, shape):
                    least, most = least + row["sure_ymd"], most + row["may_ymd"]
                elif shape[0] in "YT":
                    most += row["n"]
            elif layout not in _READS:
                most += row["n"] if shape in RUNS.values() else 0
            else:
                pattern, order = _READS[layout]
                if re.fullmatch(pattern, shape):
                    least += row[f"sure_{order}"] if HALF not in shape else 0
                    most += row[f"may_{order}"]
                elif layout == "month_name_long" and re.fullmatch(pattern.replace(LONG, SHORT), shape):
                    most += row["n"]  # May is short and long
        return least, most

    def _covers(self, layout: str, other: str) -> bool:
        """Whether a layout reads whatever another one reads of these rows."""
        for row in self.rows:
            shape = row["shape"]
            if shape in (None, NOTHING):
                continue
            if shape == ODD or other not in _READS:
                return False
            pattern, order = _READS[other]
            own = (_ISO, "ymd") if layout == ISO else _READS.get(layout, ("", ""))
            if re.fullmatch(pattern, shape) and not (re.fullmatch(own[0], shape) and order == own[1]):
                return False
        return True

    def share(self, layout: str, needed: float) -> bool | None:
        """Whether a layout reads so many rows; ``None``: the shapes do not tell."""
        least, most = self.fits(layout)
        return True if least >= needed else False if most < needed else None

    def decide(self, hint_share: float) -> tuple[bool, str | None]:
        """Whether the shapes decide on a known layout, and on which (none: none fits)."""
        hint = self.share(HINT, hint_share * self.total) if self.total else False
        if hint is None:
            return False, None
        if hint:
            return True, HINT
        bounds = {name: self.fits(name) for name in LAYOUTS if name != HINT}
        best = max(bounds, key=lambda name: bounds[name][0])
        least = bounds[best][0]
        if not any(most for _, most in bounds.values()):
            return True, None
        order = list(bounds)
        for name, (_, most) in bounds.items():
            later = order.index(name) > order.index(best)
            if name == best or later and self._covers(best, name):
                continue
            if most >= least + later:
                return False, None
        return least > 0, best if least else None

    def infer(self) -> Inferred | None:
        """A layout for most of the texts, from their shapes alone.

        The order of day and month is the one that all dates allow. If several do,
        nothing tells them apart, and ``AmbiguousTimes`` is raised.
        """
        dates: dict[str, list[dict]] = {}
        for row in self.rows:
            date = _date_part((row["shape"] or "").lstrip(WEEKDAY))
            if date:
                dates.setdefault(date, []).append(row)
        if not dates:
            return None
        date, rows = max(dates.items(), key=lambda item: (sum(r["n"] for r in item[1]), item[0]))
        orders = _orders_of(date)
        if orders == ["whole"]:
            chosen = "whole"
        else:
            counts = {order: sum(row[f"may_{order}"] for row in rows) for order in orders}
            most = max(counts.values(), default=0)
            best = [order for order, n in counts.items() if n == most]
            if not most:
                return None
            if len(best) > 1:
                raise AmbiguousTimes(f"dates like {date!r} may be read as {' or '.join(best)}")
            chosen = best[0]
        shapes = sorted({row["shape"].lstrip(WEEKDAY) for row in rows})
        return Inferred(tuple(_pattern(shape, date, chosen) for shape in shapes))


_NUMBER = f"[{ONE_OR_TWO}Y]"
_MONTH = f"[{SHORT}{LONG}]"
_DATES = [
    "[SID]",
    rf"{_NUMBER}[ ./-]{_NUMBER}[ ./-]{_NUMBER}",
    rf"n\.?[ ./-]{_MONTH}\.?,?[ ./-]{_NUMBER}",
    rf"{_MONTH}\.?[ ./-]n,?[ ./-]{_NUMBER}",
]
_TIMES = rf"(,?[ T]|T| - )?(n[:.]n([:.]n(\.f)?)?( ?{HALF})?|Y|X)?"


def _date_part(shape: str) -> str | None:
    """The date at the start of a shape, if the rest is a clock."""
    for date in _DATES:
        found = re.match(f"({date}){_TIMES}$", shape)
        if found:
            return found.group(1)
    return None


def _orders_of(date: str) -> list[str]:
    numbers = [c for c in date if c in "nY"]
    if date in RUNS.values():
        return ["whole"]
    if SHORT in date or LONG in date:
        return ["named"]
    if numbers.count("Y") > 1 or numbers[1] == "Y":
        return []
    if numbers[0] == "Y":
        return ["ymd"]
    if numbers[2] == "Y" or date[1] in "./":  # with these marks, years come last
        return ["dmy", "mdy"]
    return ["dmy", "mdy", "ymd"]


def _pattern(shape: str, date: str, order: str) -> str:
    """The reader's pattern for a shape."""
    wholes = {"D": "yyyyMMdd", "I": "yyyyMMddHHmm", "S": "yyyyMMddHHmmss"}
    fields = {"ymd": "yMd", "dmy": "dMy", "mdy": "Mdy", "named": "dy"}.get(order, "")
    clock = iter("Hms" if HALF not in shape else "hms")
    out, place = [], 0
    for i, sign in enumerate(shape):
        inside = i < len(date)
        if sign in wholes:
            out.append(wholes[sign])
        elif sign in (SHORT, LONG):
            out.append("MMM" if sign == SHORT else "MMMM")
        elif sign in "nY" and inside:
            name = fields[place]
            out.append(("yyyy" if sign == "Y" else "yy") if name == "y" else name)
            place += 1
        elif sign == "n":
            out.append(next(clock))
        elif sign == "Y":
            out.append("HHmm")
        elif sign == "X":
            out.append("HHmmss")
        elif sign == FRACTION:
            out.append("SSSSSS")
        elif sign == HALF:
            out.append("a")
        else:
            out.append("'T'" if sign == "T" else sign)
    return "".join(out)


def shapes_by_group(texts: DataFrame) -> dict[str, Shapes]:
    """The histograms of ``texts`` (``group``, ``text``); starts one job.

    What comes to the driver is one row per group and shape, and there are only so many
    shapes: their length and their signs are bounded.
    """
    found: dict[str, dict] = {}
    for row in _raw_counts(texts).collect():
        counts = row.asDict()
        group, shape = counts.pop("group"), counts.pop("shape")
        same = found.setdefault(group, {}).setdefault(shape, dict.fromkeys(counts, 0))
        for name, n in counts.items():
            same[name] += n
    return {
        group: Shapes([{"shape": shape} | counts for shape, counts in shapes.items()])
        for group, shapes in found.items()
    }


def exact_fits(texts: DataFrame, layouts: Iterable[str | Inferred], parse) -> DataFrame:
    """Per ``group``: ``rows``, ``filled``, and how many each layout reads, by reading them."""
    text = F.col("text")
    return texts.groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("text").alias("filled"),
        *[F.count(parse(text, layout)).alias(_name(layout)) for layout in layouts],
    )


def _name(layout: str | Inferred) -> str:
    return layout if isinstance(layout, str) else "inferred"


def candidates(groups: Sequence[Shapes]) -> list[str]:
    """Known layouts that may read a row of these groups."""
    return [name for name in LAYOUTS if any(shapes.fits(name)[1] for shapes in groups)]
