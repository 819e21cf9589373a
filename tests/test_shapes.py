"""Layouts from shapes: what is decided from them is what reading all texts gives."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracemill.functions.time import HINT, LAYOUTS, parse_time
from tracemill.operators.clean import (
    HINT_SHARE,
    chosen_layouts,
    choose_layout,
    time_readings,
    with_time,
)
from tracemill.operators.profile import detect_time_columns
from tracemill.operators.shapes import (
    NOTHING,
    ODD,
    AmbiguousTimes,
    Inferred,
    exact_fits,
    shape_counts,
    shapes_by_group,
    time_shape,
)


def texts(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_shapes(spark):
    wanted = {
        "2024-01-02 03.04": "Y-n-n n.n",
        "2024-1-2": "Y-n-n",
        "2024-01-02T03:04:05.123": "Y-n-nTn:n:n.f",
        "3/14/2024 9:05 PM": "n/n/Y n:n %",
        "20240102": "D",
        "20240102 1345": "D Y",
        "20240102134500": "S",
        "Jan 2, 2024": "@ n, Y",
        "2 January 2024": "n # Y",
        "may 2 2024": "@ n Y",
        "Tue, 02 Jan 2024 10:00:00": "~n @ Y n:n:n",
        "Tuesday, late": NOTHING,
        "": NOTHING,
        "unit 12": NOTHING,
        "Marta 2024": ODD,
        "2024-01-02 10:00 Europe/Berlin": ODD,
        "12345": ODD,
        "2024-01-02n": ODD,
        "1 " * 30: ODD,
        "2" * 80: NOTHING,
        None: None,
    }
    rows = texts(spark, wanted).select("t", time_shape(F.col("t")).alias("shape")).collect()
    assert {r["t"]: r["shape"] for r in rows} == wanted


def test_no_exchange_has_texts(spark):
    df = spark.range(1000).select(F.lit("g").alias("group"), F.col("id").cast("string").alias("text"))
    plan = shape_counts(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert exchanges and all("shape" in line and "text" not in line for line in exchanges)


FORMS = [
    "%Y-%m-%d %H.%M", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y %H:%M",
    "%d.%m.%Y %H:%M:%S", "%Y%m%d", "%d %b %Y", "%d %B %Y %H:%M", "%b %d, %Y", "%d-%b-%Y", "%m-%d-%Y",
    "%Y/%m/%d %H:%M:%S.%f", "%Y-%m-%d %I:%M %p", "%m/%d/%Y %I:%M:%S %p", "%Y.%m.%d",
]
BAD = ["soon", "", None, "2024-02-30 10.00", "31/02/2024", "2024-13-01", "99.99.2024", "2024", "2024-01-01 25:00",
       "2024-01-02T03:04:05Z", "12", "1.5", "Mai 2024", "2024-001-02", "10:30"]


def test_shapes_decide_as_reading_does(spark):
    """Columns of one to three layouts and of texts that are none, mixed at random."""
    pick = random.Random(5)
    rows = []
    for group in range(120):
        forms = pick.choices(FORMS, k=pick.choice([1, 1, 2, 3]))
        spoilt = pick.choice([0, 0, 0.1, 0.25, 0.6])
        last = pick.choice([12, 28])
        for _ in range(pick.choice([1, 3, 12, 40])):
            time = datetime(2024, pick.randint(1, 12), pick.randint(1, last), pick.randint(0, 23), pick.randint(0, 59))
            text = pick.choice(BAD) if pick.random() < spoilt else time.strftime(pick.choice(forms))
            rows.append((str(group), text))
    df = spark.createDataFrame(rows, "group string, text string").cache()
    exact = {r["group"]: r.asDict() for r in exact_fits(df, LAYOUTS, parse_time).collect()}
    found = shapes_by_group(df)
    assert chosen_layouts(df, found) == {group: choose_layout(fits) for group, fits in exact.items()}
    decided = 0
    for group, shapes in found.items():
        assert (shapes.total, shapes.filled) == (exact[group]["rows"], exact[group]["filled"])
        decided += shapes.decide(HINT_SHARE)[0]
        for layout in LAYOUTS:
            least, most = shapes.fits(layout)
            assert least <= exact[group][layout] <= most, (layout, shapes.rows)
    assert decided > 60  # most of them need no second look
    df.unpersist()


@pytest.mark.parametrize(
    "values, times",
    [
        (["Jan 2 2024", "May 30 2024"], [datetime(2024, 1, 2), datetime(2024, 5, 30)]),
        (["13.02.24 07:30", "01.02.24 07:31:05"], [datetime(2024, 2, 13, 7, 30), datetime(2024, 2, 1, 7, 31, 5)]),
        (["2/13/24"], [datetime(2024, 2, 13)]),
        (["20240102 1345", "20240102 134501"], [datetime(2024, 1, 2, 13, 45), datetime(2024, 1, 2, 13, 45, 1)]),
        (["20240102134501", "x"], [datetime(2024, 1, 2, 13, 45, 1), None]),
        (["Tue, 02 Jan 2024 10:00:00"], [datetime(2024, 1, 2, 10)]),
        (["Tuesday 2 January 2024"], [datetime(2024, 1, 2)]),
        (["31 12 2024 23:59"], [datetime(2024, 12, 31, 23, 59)]),
        (["2024/31/12", "2024/12/31 5:06PM"], [None, datetime(2024, 12, 31, 17, 6)]),
        (["13-Feb-24 5.06"], [datetime(2024, 2, 13, 5, 6)]),
    ],
)
def test_layouts_outside_the_list(spark, values, times):
    df = texts(spark, values)
    assert isinstance(time_readings(df, "t")[""].layout, Inferred)
    assert [r[0] for r in with_time(df, "t").collect()] == times


@pytest.mark.parametrize("values", [["01 02 2024", "03 04 2024"], ["01-02-03"], ["1/2/24 10:00", "soon"]])
def test_ambiguous_dates_raise(spark, values):
    with pytest.raises(AmbiguousTimes, match="all rows.*dmy or mdy"):
        with_time(texts(spark, values), "t")


def test_time_columns_of_unlisted_layouts(spark):
    rows = [("Jan 2 2024", "01 02 2024", "10.2.30.4", f"unit {i}", f"{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert detect_time_columns(df) == ["a"]


def test_rows_count_not_distinct_texts(spark):
    """Eight rows of ten in the hint layout, though of one text only."""
    df = texts(spark, ["2024-01-01 10.30"] * 8 + ["2024-01-01 11:30", "2024-01-01 12:30"])
    assert time_readings(df, "t")[""].layout == HINT
