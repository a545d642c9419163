"""All six marts from one scan of the flights.

The marts group by subsets of eight columns and use sums and counts only, so
one aggregate by all eight holds everything they need. It has a row per month,
airline and route, not per flight. Averages are rebuilt from a sum and the
number of values in it, before rounding, which gives the same results as the
direct form in ``skyledger.operators.marts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import arrived_late
from skyledger.functions.figures import flag_total, mean, percent
from skyledger.operators.marts import (
    AVERAGED_SIDES,
    CARRIER,
    MONTH_CARRIER,
    ROUTE,
    TIER_COUNTS,
    airport_sums,
    bottlenecks_of,
    detail_of,
    top_carriers,
)
from skyledger.schema import CAUSES

KEYS = ["flight_year", "flight_month", *CARRIER, *ROUTE]
AVERAGED = ["dep_delay", "arr_delay", "taxi_out", "taxi_in", "air_time"]


Total = Callable[[str], Column]


def measures() -> list[Column]:
    """The additive measures of a group of staging rows."""
    is_late = arrived_late(F.col("arr_delay"))
    return [
        F.count("*").alias("flights"),
        flag_total(F.col("cancelled")).alias("cancelled"),
        flag_total(F.col("diverted")).alias("diverted"),
        *[F.sum(c).alias(f"{c}_sum") for c in AVERAGED],
        *[F.count(c).alias(f"{c}_n") for c in AVERAGED],
        *[
            F.count_if(F.col("delay_category") == tier).alias(name)
            for name, tier in TIER_COUNTS.items()
        ],
        F.count_if(is_late).alias("late_flights"),
        F.sum(F.when(is_late, F.col("arr_delay"))).alias("late_minutes"),
        *[F.sum(F.when(is_late, F.col(c))).alias(f"late_{c}") for c in CAUSES],
    ]


def flight_base(staging: DataFrame) -> DataFrame:
    """Additive measures by month, airline and route."""
    return staging.groupBy(*KEYS).agg(*measures())


def _mean(column: str, total: Total) -> Column:
    return mean(total(f"{column}_sum"), total(f"{column}_n"))


# The figures of each mart. ``total`` gives a measure of the whole group: its sum
# over the rows of the base, or the column itself where groups are finished.


def delay_figures(total: Total) -> list[Column]:
    flights, cancelled, diverted = total("flights"), total("cancelled"), total("diverted")
    return [
        flights.alias("total_flights"),
        cancelled.alias("total_cancelled_flights"),
        percent(cancelled, flights).alias("cancellation_rate_pct"),
        diverted.alias("total_diverted_flights"),
        percent(diverted, flights).alias("diverted_rate_pct"),
        _mean("dep_delay", total).alias("avg_dep_delay_mins"),
        _mean("arr_delay", total).alias("avg_arr_delay_mins"),
        *[total(name).alias(name) for name in TIER_COUNTS],
    ]


def cause_figures(total: Total) -> list[Column]:
    minutes = total("late_minutes")
    return [
        total("late_flights").alias("total_delayed_flights"),
        minutes.alias("total_delay_minutes"),
        *[percent(total(f"late_{c}"), minutes).alias(f"{c}_pct") for c in CAUSES],
    ]


def carrier_figures(total: Total) -> list[Column]:
    flights, diverted = total("flights"), total("diverted")
    return [
        flights.alias("total_flights"),
        diverted.alias("total_diverted_flights"),
        percent(diverted, flights).alias("diverted_rate_pct"),
    ]


def route_figures(total: Total) -> list[Column]:
    flights, cancelled = total("flights"), total("cancelled")
    return [
        flights.alias("total_flights"),
        _mean("air_time", total).alias("avg_air_time_mins"),
        cancelled.alias("total_cancelled"),
        percent(cancelled, flights).alias("cancellation_rate_pct"),
        _mean("dep_delay", total).alias("avg_dep_delay_mins"),
        _mean("arr_delay", total).alias("avg_arr_delay_mins"),
    ]


def delay_by_carrier(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return base.groupBy(*MONTH_CARRIER).agg(*delay_figures(F.sum))


def root_causes(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return base.where(F.col("late_flights") > 0).groupBy(*CARRIER).agg(*cause_figures(F.sum))


def flights_by_carrier(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return base.groupBy(*CARRIER).agg(*carrier_figures(F.sum))


def route_performance(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return base.groupBy(*ROUTE).agg(*route_figures(F.sum))


def top_carrier(base: DataFrame) -> DataFrame:
    """Airline with most departures per airport, from the base."""
    counts = base.groupBy(F.col("origin").alias("airport_code"), "reporting_airline").agg(
        F.sum("flights").alias("flight_count")
    )
    return top_carriers(counts)


def _side_sums() -> list[Column]:
    names = ["flights", "diverted", *[f"{c}_{x}" for c in AVERAGED_SIDES for x in ("sum", "n")]]
    return [F.sum(name).alias(name) for name in names]


def airport_bottlenecks(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return bottlenecks_of(airport_sums(base, _side_sums(), cities=True, leaders=False))


def airport_detail(base: DataFrame) -> DataFrame:
    """Mart of the same name, from the base."""
    return detail_of(airport_sums(base, _side_sums(), cities=False, leaders=True))


MARTS = {
    "delay_by_carrier": delay_by_carrier,
    "root_causes": root_causes,
    "flights_by_carrier": flights_by_carrier,
    "airport_bottlenecks": airport_bottlenecks,
    "airport_detail": airport_detail,
    "route_performance": route_performance,
}
