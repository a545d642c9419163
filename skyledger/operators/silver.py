"""Landing text to the typed, filled, enriched silver rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import LAST_TIER, delay_category, is_delayed
from skyledger.functions.parsing import PARSERS, strict_flag
from skyledger.schema import CAUSES, FLIGHT_COLUMNS, SILVER_COLUMNS
from skyledger.sources.lookups import Lookups

# Fixed value: cancellation code of flights that were not cancelled.
NO_CODE = "N/A"


def typed(landing: DataFrame, strict_flags: bool = False) -> DataFrame:
    """The 28 columns parsed and renamed, nothing filled."""
    parsers = {**PARSERS, "boolean": strict_flag} if strict_flags else PARSERS
    return landing.select(
        *[parsers[kind](F.col(source)).alias(name) for source, name, kind in FLIGHT_COLUMNS]
    )


def filled(flights: DataFrame, fill_causes: bool = True) -> DataFrame:
    """Missing cause minutes as 0 and a missing cancellation code as N/A."""
    fills = {"cancellation_code": F.lit(NO_CODE)}
    if fill_causes:
        fills.update({cause: F.lit(0) for cause in CAUSES})
    return flights.select(
        *[
            F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c)
            for c in flights.columns
        ]
    )


def enriched(flights: DataFrame, lookups: Lookups, null_as: str | None = LAST_TIER) -> DataFrame:
    """Names from the three lookups, and the two columns derived from the delay."""
    named = lookups.carriers.join_to(flights, "reporting_airline")
    named = lookups.airports.join_to(named, "origin")
    named = lookups.cancellation.join_to(named, "cancellation_code")
    minutes = F.col("arr_delay")
    return named.withColumns(
        {
            "is_delayed": is_delayed(minutes),
            "delay_category": delay_category(minutes, null_as),
        }
    ).select(*SILVER_COLUMNS)


def build_silver(
    landing: DataFrame,
    lookups: Lookups,
    fill_causes: bool = True,
    strict_flags: bool = False,
    null_as: str | None = LAST_TIER,
) -> DataFrame:
    """The 33 silver columns of the landing rows. No row is dropped.

    Row-wise work and broadcast joins only: there is no shuffle, so a month's
    size never decides how many tasks work on it.
    """
    return enriched(filled(typed(landing, strict_flags), fill_causes), lookups, null_as)
