"""Distinct counts that merge: a HyperLogLog sketch per month and column.

Exact distinct counts of a selection of months need all its flights. A sketch of a
month is a few kilobytes whatever the month holds, sketches of months combine into the
sketch of all, and a changed month replaces its own alone. With ``log_size`` k the
standard error is about 1.04 / sqrt(2**k), and small counts are exact or nearly so.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.plans.monthly import month_filter
from skyledger.schema import MONTH_KEYS
from skyledger.sources.tables import replace_all, replace_months

COLUMNS = ("reporting_airline", "origin", "dest")
LOG_SIZE = 12


def monthly_sketches(flights: DataFrame, columns: Iterable[str] = COLUMNS, log_size: int = LOG_SIZE) -> DataFrame:
    """A sketch of every column's values for every month; nulls do not count."""
    return flights.groupBy(*MONTH_KEYS).agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), log_size).alias(c) for c in columns]
    )


def refresh_sketches(
    flights: DataFrame, path: str, months: Iterable[tuple[int, int]] | None = None,
    columns: Iterable[str] = COLUMNS, log_size: int = LOG_SIZE,
) -> None:
    """Stores the sketches of all months, or those of the given months anew.

    Only flights of the given months are read; one without flights loses its sketch.
    """
    if months is None:
        replace_all(monthly_sketches(flights, columns, log_size), path)
        return
    months = set(months)
    changed = monthly_sketches(flights.where(month_filter(months)), columns, log_size)
    replace_months(changed, path, gather=True, months=months)


def distinct_estimates(
    spark: SparkSession, path: str, year: int | None = None, columns: Iterable[str] = COLUMNS
) -> DataFrame:
    """One row of distinct counts of the selected months, from stored sketches alone."""
    sketches = spark.read.parquet(path)
    if year is not None:
        sketches = sketches.where(F.col("year") == year)
    return sketches.agg(
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(f"{c}_count") for c in columns]
    )
