"""All six marts from one grouping-sets aggregate over one reading of the flights.

Each flight counts in seven groups at once: by month and airline, by airline and name,
by route, by airport on either side (arrivals with and without their city), and by
airport and airline. All are summed on the map side, so what is shuffled is one row
per group and task; what is stored is one row per group, the cells. A cell is finished:
four marts are a projection of theirs, the two airport marts let the sides of an
airport meet. ``skyledger.plans.base`` keeps more, a row per month, airline and route,
so that one changed month can be summed again; the cells are for a build of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.marts import (
    AIRPORT_CARRIER,
    ARRIVING,
    ARRIVING_CITY,
    CARRIER,
    LEAVING,
    MONTH_CARRIER,
    ROUTE,
    bottlenecks_of,
    detail_of,
    grouping_sets,
    sides,
)
from skyledger.plans import base

SETS = {
    "month_carrier": MONTH_CARRIER,
    "carrier": CARRIER,
    "route": ROUTE,
    "leaving": LEAVING,
    "arriving_city": ARRIVING_CITY,
    "arriving": ARRIVING,
    "airport_carrier": AIRPORT_CARRIER,
}


def mart_cells(staging: DataFrame) -> DataFrame:
    """One row per group of every set: ``cell`` names the set, keys of others are null."""
    return grouping_sets(staging, SETS, base.measures())


def _of(cells: DataFrame, name: str) -> DataFrame:
    return cells.where(F.col("cell") == name)


def delay_by_carrier(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    return _of(cells, "month_carrier").select(*MONTH_CARRIER, *base.delay_figures(F.col))


def root_causes(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    late = _of(cells, "carrier").where(F.col("late_flights") > 0)
    return late.select(*CARRIER, *base.cause_figures(F.col))


def flights_by_carrier(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    return _of(cells, "carrier").select(*CARRIER, *base.carrier_figures(F.col))


def route_performance(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    return _of(cells, "route").select(*ROUTE, *base.route_figures(F.col))


def airport_bottlenecks(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    return bottlenecks_of(sides(cells, {"leaving": "leaving", "arriving": "arriving_city"}))


def airport_detail(cells: DataFrame) -> DataFrame:
    """Mart of the same name, from the cells."""
    cell_of = {"leaving": "leaving", "arriving": "arriving", "carrier": "airport_carrier"}
    return detail_of(sides(cells, cell_of))


MARTS = {
    "delay_by_carrier": delay_by_carrier,
    "root_causes": root_causes,
    "flights_by_carrier": flights_by_carrier,
    "airport_bottlenecks": airport_bottlenecks,
    "airport_detail": airport_detail,
    "route_performance": route_performance,
}
