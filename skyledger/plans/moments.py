"""Means, deviations and correlations that merge: exact sums per month.

For every column a month keeps the number of known values, their sum, their sum of
squares, minimum and maximum; for every pair of columns the same sums over the rows
where both are known, and the sum of products. Whole numbers add up exactly, so any
selection of months gives what its flights give, without reading them: sums of months
are taken as 38-digit decimals, and the differences that a deviation is made of are
exact before they become floating-point. Columns must be whole numbers or flags.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.figures import round_half_up
from skyledger.operators.profile import FLAGS, NUMERIC
from skyledger.plans.monthly import month_filter
from skyledger.schema import CAUSES, MONTH_KEYS
from skyledger.sources.tables import replace_all, replace_months

#: Columns described, and columns correlated with each other.
DESCRIBED = [c for c in NUMERIC + FLAGS if c not in MONTH_KEYS]
CORRELATED = [*CAUSES, "arr_delay"]


def _pairs(columns: Iterable[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(columns, 2))


def monthly_moments(
    flights: DataFrame, described: list[str] = DESCRIBED, correlated: list[str] = CORRELATED
) -> DataFrame:
    """The sums of every month."""

    def value(name: str) -> Column:
        return F.col(name).cast("int").cast("bigint")

    sums = []
    for c in described:
        x = value(c)
        sums += [
            F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum(x * x).alias(f"{c}_q"),
            F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
        ]
    for a, b in _pairs(correlated):
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(known, value(a)), F.when(known, value(b))
        parts = {"n": F.count(x), "a": F.sum(x), "b": F.sum(y), "aa": F.sum(x * x), "bb": F.sum(y * y), "ab": F.sum(x * y)}
        sums += [part.alias(f"{a}__{b}_{k}") for k, part in parts.items()]
    return flights.groupBy(*MONTH_KEYS).agg(*sums)


def refresh_moments(
    flights: DataFrame, path: str, months: Iterable[tuple[int, int]] | None = None,
    described: list[str] = DESCRIBED, correlated: list[str] = CORRELATED,
) -> None:
    """Stores the sums of all months, or those of the given months anew."""
    if months is None:
        replace_all(monthly_moments(flights, described, correlated), path)
        return
    months = set(months)
    changed = monthly_moments(flights.where(month_filter(months)), described, correlated)
    replace_months(changed, path, gather=True, months=months)


def _selected(spark: SparkSession, path: str, year: int | None) -> DataFrame:
    moments = spark.read.parquet(path)
    return moments if year is None else moments.where(F.col("year") == year)


def _exact(name: str) -> Column:
    """The sum of a column over the months."""
    return F.sum(F.col(name).cast("decimal(38,0)"))


def describe(spark: SparkSession, path: str, year: int | None = None, described: list[str] = DESCRIBED) -> DataFrame:
    """Minimum, mean, maximum and sample deviation of each column over the selected months."""
    total = _selected(spark, path, year).agg(
        *[
            column
            for c in described
            for column in (
                *[_exact(f"{c}_{k}").alias(f"{c}_{k}") for k in "nsq"],
                F.min(f"{c}_min").alias(f"{c}_min"),
                F.max(f"{c}_max").alias(f"{c}_max"),
            )
        ]
    )

    def row(c: str) -> Column:
        n, s, q = (F.col(f"{c}_{k}") for k in "nsq")
        spread, freedom = (n * q - s * s).cast("double"), (n * (n - 1)).cast("double")
        figures = {
            "min": F.col(f"{c}_min").cast("double"),
            "mean": F.try_divide(s.cast("double"), n.cast("double")),
            "max": F.col(f"{c}_max").cast("double"),
            "std": F.sqrt(F.try_divide(spread, freedom)),
        }
        return F.struct(
            F.lit(c).alias("column_name"),
            *[round_half_up(figure, 2).alias(f"{k}_value") for k, figure in figures.items()],
        )

    return total.select(F.inline(F.array(*[row(c) for c in described])))


def correlation(
    spark: SparkSession, path: str, year: int | None = None, correlated: list[str] = CORRELATED
) -> DataFrame:
    """Pearson correlation of every two columns over the selected months."""
    pairs = _pairs(correlated)
    names = [f"{a}__{b}_{k}" for a, b in pairs for k in ("n", "a", "b", "aa", "bb", "ab")]
    total = _selected(spark, path, year).agg(*[_exact(name).alias(name) for name in names])

    def row(a: str, b: str, first: str, second: str) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"{a}__{b}_{k}") for k in ("n", "a", "b", "aa", "bb", "ab"))
        spread = (n * xx - x * x).cast("double") * (n * yy - y * y).cast("double")
        value = F.try_divide((n * xy - x * y).cast("double"), F.sqrt(spread))
        return F.struct(
            F.lit(first).alias("column_a"),
            F.lit(second).alias("column_b"),
            round_half_up(value, 6).alias("correlation"),
        )

    rows = [row(a, b, a, b) for a, b in pairs] + [row(a, b, b, a) for a, b in pairs if a != b]
    return total.select(F.inline(F.array(*rows)))
