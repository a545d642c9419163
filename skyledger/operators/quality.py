"""Declarative checks: each reports how many failures it found."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.delays import CATEGORIES

# The checks on the staging view and the six marts.
NOT_NULL = {
    "staging": ["flight_date", "reporting_airline", "origin", "dest"],
    "delay_by_carrier": ["flight_year", "flight_month", "reporting_airline"],
    "airport_bottlenecks": ["airport_code"],
    "root_causes": ["reporting_airline"],
    "flights_by_carrier": ["reporting_airline"],
    "route_performance": ["origin", "dest"],
    "airport_detail": ["airport_code"],
}
UNIQUE = {
    "airport_bottlenecks": ["airport_code"],
    "root_causes": ["reporting_airline"],
    "flights_by_carrier": ["reporting_airline"],
    "airport_detail": ["airport_code"],
}
ACCEPTED = {"staging": {"delay_category": CATEGORIES}}


def not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows with a null, for all columns of a table in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("not_null").alias("check_name"),
                        F.lit(table).alias("table_name"),
                        F.lit(c).alias("column_name"),
                        F.col(c).alias("failures"),
                    )
                    for c in columns
                ]
            )
        )
    )


def _report(failures: DataFrame, check: str, table: str, column: str) -> DataFrame:
    return failures.select(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        "failures",
    )


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Values that occur more than once; nulls do not count."""
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return _report(
        per_value.agg(F.count_if(F.col("n") > 1).alias("failures")), "unique", table, column
    )


def accepted_values(
    df: DataFrame, table: str, column: str, values: list[str], allow_null: bool = True
) -> DataFrame:
    """Different values outside the list. Null passes unless told otherwise."""
    outside = ~F.col(column).isin(*values)
    per_value = df.groupBy(column).agg(F.count("*").alias("n"))
    bad = F.coalesce(outside, F.lit(not allow_null))
    return _report(
        per_value.agg(F.count_if(bad).alias("failures")), "accepted_values", table, column
    )


def not_null_suite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The 13 not-null checks."""
    return reduce(
        DataFrame.unionByName, [not_null(tables[t], t, columns) for t, columns in NOT_NULL.items()]
    )


def unique_suite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The 4 uniqueness checks."""
    return reduce(
        DataFrame.unionByName,
        [unique(tables[t], t, c) for t, columns in UNIQUE.items() for c in columns],
    )


def accepted_suite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The accepted-values check."""
    return reduce(
        DataFrame.unionByName,
        [
            accepted_values(tables[t], t, c, values)
            for t, columns in ACCEPTED.items()
            for c, values in columns.items()
        ],
    )


def suite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All 18 checks."""
    return (
        not_null_suite(tables).unionByName(unique_suite(tables)).unionByName(accepted_suite(tables))
    )


def layer_row_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per month of each layer side by side, and whether they agree.

    Layers need integer ``year`` and ``month`` columns.
    """
    names = list(layers)
    counts = reduce(
        DataFrame.unionByName,
        [
            layers[name]
            .groupBy("year", "month")
            .agg(*[(F.count("*") if name == other else F.lit(0).cast("bigint")).alias(f"{other}_rows") for other in names])
            for name in names
        ],
    )
    merged = counts.groupBy("year", "month").agg(
        *[F.sum(f"{name}_rows").alias(f"{name}_rows") for name in names]
    )
    agree = F.lit(True)
    for name in names[1:]:
        agree = agree & (F.col(f"{name}_rows") == F.col(f"{names[0]}_rows"))
    return merged.withColumn("agree", agree)


class WriteChecks:
    """The checks, counted by the jobs that write the tables.

    ``watch`` adds counters to a table on its way to a writer; once all are written,
    ``report`` has the results without a job of its own. Uniqueness is told from the
    codes themselves, a code per mart row, which airports and airlines keep few; the
    values outside a list are kept as a set. A task run again after its executor was
    lost may count its failures twice, never fewer.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, table: str) -> DataFrame:
        """The same rows, counted as they pass."""
        counters = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in NOT_NULL.get(table, [])]
        counters += [F.collect_list(c).alias(f"unique_{c}") for c in UNIQUE.get(table, [])]
        counters += [
            F.collect_set(F.when(~F.col(c).isin(*values), F.col(c))).alias(f"outside_{c}")
            for c, values in ACCEPTED.get(table, {}).items()
        ]
        if not counters:
            return df
        self.seen[table] = Observation()
        return df.observe(self.seen[table], *counters)

    def failures(self) -> list[tuple[str, str, str, int]]:
        """Check, table, column and failures of everything that was written."""
        out = []
        for table, observation in self.seen.items():
            got = observation.get
            out += [("not_null", table, c, got[f"null_{c}"]) for c in NOT_NULL.get(table, [])]
            for c in UNIQUE.get(table, []):
                repeated = sum(n > 1 for n in Counter(got[f"unique_{c}"]).values())
                out.append(("unique", table, c, repeated))
            for c in ACCEPTED.get(table, {}):
                out.append(("accepted_values", table, c, len(got[f"outside_{c}"])))
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """The results as the suites return them."""
        kind = "check_name string, table_name string, column_name string, failures bigint"
        return spark.createDataFrame(self.failures(), kind)
