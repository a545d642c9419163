"""Rounding, rates, clock times and small code lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of small code sets.
CANCELLATION_LABELS = {
    "A": "Carrier (A)",
    "B": "Weather (B)",
    "C": "NAS (C)",
    "D": "Security (D)",
}
WEEKDAY_LABELS = {1: "Pzt", 2: "Sal", 3: "Çar", 4: "Per", 5: "Cum", 6: "Cmt", 7: "Paz"}
MONTH_NAMES = {
    1: "Jan",
    2: "Feb",
    3: "Mar",
    4: "Apr",
    5: "May",
    6: "Jun",
    7: "Jul",
    8: "Aug",
    9: "Sep",
    10: "Oct",
    11: "Nov",
    12: "Dec",
}


def round_half_up(value: Column, places: int) -> Column:
    """Round through decimal, so that halves do not depend on binary noise."""
    exact = value.try_cast("decimal(28,10)")
    return F.round(exact, places).cast("double")


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` in percent of ``whole``; null when there is nothing to divide by."""
    return round_half_up(F.try_divide(part, whole) * 100, places)


def mean(total: Column, count: Column, places: int = 2) -> Column:
    """Average rebuilt from a sum and the number of non-null values in it."""
    return round_half_up(F.try_divide(total, count), places)


def flag_total(column: Column) -> Column:
    """Number of true values, null when the group has no value at all."""
    return F.sum(column.cast("bigint"))


def hour_of(hhmm: Column) -> Column:
    """Hour of an ``hhmm`` integer: 1435 is 14, 2400 is 24."""
    return F.floor(hhmm / 100).cast("int")


def clock_time(day: Column, hhmm: Column) -> Column:
    """Local date and ``hhmm`` as a timestamp without zone.

    2400 is midnight at the end of the day. Impossible times are null.
    """
    hours, minutes = hour_of(hhmm), F.pmod(hhmm, F.lit(100)).cast("int")
    valid = (hhmm >= 0) & (hhmm <= 2400) & (minutes < 60)
    return F.when(
        valid,
        day.cast("timestamp_ntz")
        + F.make_dt_interval(hours=hours, mins=minutes),
    )


def clip(value: Column, low: int, high: int) -> Column:
    """Limit to [low, high]; null stays null."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def label(code: Column, labels: dict) -> Column:
    """Label of a code, null for codes outside the list."""
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), code)
