"""Column profiles and distributions of the flight rows.

Wide summaries are one aggregate over one scan, turned into rows afterwards.
Exact distinct counts and histograms first count rows per value, which
combines on the map side, and work on those counts from then on.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import PROFILE_LABELS, PROFILE_ORDER, UNKNOWN, delay_category
from skyledger.functions.delays import is_delayed as late
from skyledger.functions.figures import (
    CANCELLATION_LABELS,
    WEEKDAY_LABELS,
    clip,
    hour_of,
    label,
    percent,
    round_half_up,
)
from skyledger.schema import CAUSES, FLIGHT_TYPES

NUMERIC = [name for name, kind in FLIGHT_TYPES.items() if kind == "int"]
# Numbers in the landing files, too: 1 for true.
FLAGS = [name for name, kind in FLIGHT_TYPES.items() if kind == "boolean"]

# Limits beyond which a value is looked at as an outlier.
SHORTEST_DISTANCE = 0
EARLIEST_ARRIVAL = -120
LATEST_ARRIVAL = 600


def _as_rows(one_row: DataFrame, records: list[Column]) -> DataFrame:
    """One output row per struct built from a one-row frame."""
    return one_row.select(F.inline(F.array(*records)))


def row_counts(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count")
    )


def describe(df: DataFrame, columns: list[str] = NUMERIC + FLAGS) -> DataFrame:
    """Minimum, mean, maximum and sample deviation of each column, flags as 0 and 1."""
    measures = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp}
    summary = df.agg(
        *[
            fn(F.col(c).cast("int")).cast("double").alias(f"{m}_{c}")
            for c in columns
            for m, fn in measures.items()
        ]
    )
    return _as_rows(
        summary,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                *[round_half_up(F.col(f"{m}_{c}"), 2).alias(f"{m}_value") for m in measures],
            )
            for c in columns
        ],
    )


def null_shares(df: DataFrame) -> DataFrame:
    """Null count and share of every column."""
    counts = df.agg(
        F.count("*").alias("all_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return _as_rows(
        counts,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).alias("null_count"),
                percent(F.col(c), F.col("all_rows")).alias("null_pct"),
            )
            for c in df.columns
        ],
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that have nulls, most nulls first."""
    return (
        null_shares(df)
        .where(F.col("null_count") > 0)
        .orderBy(F.desc("null_count"), F.asc("column_name"))
    )


def critical_nulls(flights: DataFrame, above_pct: float = 5.0) -> DataFrame:
    """Columns mostly expected to be filled that are not, among flown flights."""
    return (
        null_shares(flights.where(~F.col("cancelled")))
        .where(F.col("null_pct") > above_pct)
        .select("column_name", "null_pct")
        .orderBy(F.desc("null_pct"), F.asc("column_name"))
    )


def null_by_cancelled(flights: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null share of the columns among cancelled and among flown flights."""
    chosen = columns or [*CAUSES, "cancellation_code", "dep_time", "arr_time"]
    return (
        flights.where(F.col("cancelled").isNotNull())
        .groupBy("cancelled")
        .agg(
            F.count("*").alias("flights"),
            *[
                percent(F.count_if(F.col(c).isNull()), F.count("*")).alias(f"{c}_null_pct")
                for c in chosen
            ],
        )
    )


def all_null_share(flights: DataFrame, columns: list[str] = CAUSES) -> DataFrame:
    """Share of cancelled flights on which every given column is null."""
    empty = F.lit(True)
    for c in columns:
        empty = empty & F.col(c).isNull()
    return flights.where(F.col("cancelled")).agg(
        F.count("*").alias("cancelled_flights"),
        percent(F.count_if(empty), F.count("*"), 1).alias("all_null_pct"),
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values of each column, as text.

    Combinations are made distinct first: few rows, whatever the table's size.
    """
    seen = df.select(*columns).distinct()
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    return seen.select(F.inline(F.array(*pairs))).distinct()


def distinct_counts(
    df: DataFrame, columns: list[str] = ("reporting_airline", "origin", "dest"), rsd: float | None = None
) -> DataFrame:
    """Number of different values per column, exact unless ``rsd`` is given.

    The exact form counts over the distinct combinations instead of copying
    every flight once per column.
    """
    if rsd is not None:
        return df.agg(*[F.approx_count_distinct(c, rsd).alias(f"{c}_count") for c in columns])
    seen = df.select(*columns).distinct()
    return seen.agg(*[F.count_distinct(c).alias(f"{c}_count") for c in columns])


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Flights per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("flight_count"))


def top_by_count(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The keys with most flights."""
    counts = count_by(df.where(F.col(key).isNotNull()), key)
    return counts.orderBy(F.desc("flight_count"), F.asc(key)).limit(n)


def flights_by_weekday(flights: DataFrame) -> DataFrame:
    """Flights per weekday with its label."""
    return (
        count_by(flights.where(F.col("day_of_week").isNotNull()), "day_of_week")
        .withColumn("weekday", label(F.col("day_of_week"), WEEKDAY_LABELS))
        .orderBy("day_of_week")
    )


def flights_by_day(flights: DataFrame) -> DataFrame:
    """Flights per date."""
    return count_by(flights.where(F.col("flight_date").isNotNull()), "flight_date").orderBy(
        "flight_date"
    )


def departures_by_hour(flights: DataFrame) -> DataFrame:
    """Flights per scheduled departure hour; 2400 is left out."""
    hour = hour_of(F.col("crs_dep_time")).alias("dep_hour")
    return count_by(flights.select(hour).where(F.col("dep_hour") <= 23), "dep_hour").orderBy(
        "dep_hour"
    )


def distance_stats(flights: DataFrame) -> DataFrame:
    """Shortest, longest and mean distance."""
    return flights.agg(
        F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"),
        round_half_up(F.avg("distance"), 0).alias("mean_distance"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed.

    The bounds come first, in an aggregate of their own; rows are then counted by bin
    where they are read. So a task sends one row per bin at most, also where all
    values differ, for reading one column twice. Empty bins are listed. One single
    value gets a width of one around it.
    """
    values = df.select(value.cast("double").alias("value")).where(F.col("value").isNotNull())
    bounds = values.agg(
        F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("bounds")
    ).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    single = low == high
    start = F.when(single, low - 0.5).otherwise(low)
    span = F.when(single, F.lit(1.0)).otherwise(high - low)
    place = F.least(F.floor((F.col("value") - start) * bins / span), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    filled = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"))
    every_bin = filled.where(low.isNotNull()).select(
        start.alias("start"), span.alias("span"), "filled",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    edge = F.col("start") + F.col("bin") * F.col("span") / bins
    return every_bin.select(
        "bin",
        round_half_up(edge, 6).alias("bin_start"),
        round_half_up(edge + F.col("span") / bins, 6).alias("bin_end"),
        F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0)).alias("flight_count"),
    )


def distance_histogram(flights: DataFrame, bins: int = 60) -> DataFrame:
    """Flights by distance."""
    return histogram(flights, F.col("distance"), bins)


def arrival_delay_histogram(flights: DataFrame, bins: int = 80) -> DataFrame:
    """Flights by arrival delay, limited to one hour early and three late."""
    return histogram(flights, clip(F.col("arr_delay"), -60, 180), bins)


def flag_rates(flights: DataFrame) -> DataFrame:
    """Diverted, late and early shares.

    Late is a share of all flights, early only of those with a delay value.
    """
    minutes = F.col("arr_delay")
    return flights.agg(
        percent(F.sum(F.col("diverted").cast("int")), F.count("diverted")).alias("diverted_pct"),
        percent(F.count_if(late(minutes)), F.count("*")).alias("late_pct_of_all"),
        percent(F.count_if(minutes < 0), F.count("arr_delay")).alias("early_pct_of_known"),
    )


def cancel_reasons(flights: DataFrame) -> DataFrame:
    """Cancelled flights by reason label; unknown codes are left out."""
    named = flights.select(label(F.col("cancellation_code"), CANCELLATION_LABELS).alias("reason"))
    return count_by(named.where(F.col("reason").isNotNull()), "reason").orderBy(
        F.desc("flight_count"), F.asc("reason")
    )


def cancel_rate_top(flights: DataFrame, n: int = 10) -> DataFrame:
    """Airlines with the highest share of cancelled flights."""
    cancelled, known = F.sum(F.col("cancelled").cast("bigint")), F.count("cancelled")
    return (
        flights.groupBy("reporting_airline")
        .agg(
            cancelled.alias("cancelled_flights"),
            known.alias("flights"),
            round_half_up(F.try_divide(cancelled, known) * 100, 6).alias("cancel_rate"),
        )
        .orderBy(F.desc_nulls_last("cancel_rate"), F.asc("reporting_airline"))
        .limit(n)
    )


def avg_delay_top(flights: DataFrame, n: int = 10) -> DataFrame:
    """Airlines with the highest mean arrival delay."""
    return (
        flights.groupBy("reporting_airline")
        .agg(round_half_up(F.avg("arr_delay"), 6).alias("avg_arr_delay"))
        .orderBy(F.desc_nulls_last("avg_arr_delay"), F.asc("reporting_airline"))
        .limit(n)
    )


def category_shares(flights: DataFrame) -> DataFrame:
    """Flights per delay tier in fixed order, absent tiers as 0."""
    tier = delay_category(F.col("arr_delay"), UNKNOWN, PROFILE_LABELS)
    counts = flights.select(tier.alias("tier")).agg(
        F.count("*").alias("all_rows"),
        *[F.count_if(F.col("tier") == name).alias(f"n{i}") for i, name in enumerate(PROFILE_ORDER)],
    )
    return _as_rows(
        counts,
        [
            F.struct(
                F.lit(i + 1).alias("place"),
                F.lit(name).alias("category"),
                F.col(f"n{i}").alias("flight_count"),
                percent(F.col(f"n{i}"), F.col("all_rows")).alias("pct"),
            )
            for i, name in enumerate(PROFILE_ORDER)
        ],
    )


def cause_shares(flights: DataFrame) -> DataFrame:
    """Share of each cause in the minutes of all causes, over all flights."""
    sums = flights.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CAUSES])
    total = sum((F.col(c) for c in CAUSES), F.lit(0))
    return _as_rows(
        sums,
        [
            F.struct(
                F.lit(c).alias("cause"),
                F.col(c).alias("minutes"),
                percent(F.col(c), total).alias("pct"),
            )
            for c in CAUSES
        ],
    )


def delay_corr(flights: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every two columns, over rows where both are known."""
    chosen = columns or [*CAUSES, "arr_delay"]
    pairs = list(combinations_with_replacement(chosen, 2))
    known = flights.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    both = pairs + [(b, a) for a, b in pairs if a != b]
    value = {**{(a, b): f"{a}__{b}" for a, b in pairs}, **{(b, a): f"{a}__{b}" for a, b in pairs}}
    return _as_rows(
        known,
        [
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                round_half_up(F.col(value[(a, b)]), 6).alias("correlation"),
            )
            for a, b in both
        ],
    )


def outlier_counts(flights: DataFrame) -> DataFrame:
    """Rows outside each plausibility limit."""
    rules = {
        "distance_not_positive": F.col("distance") <= SHORTEST_DISTANCE,
        "arrival_too_early": F.col("arr_delay") < EARLIEST_ARRIVAL,
        "arrival_too_late": F.col("arr_delay") > LATEST_ARRIVAL,
    }
    counts = flights.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return _as_rows(
        counts,
        [
            F.struct(F.lit(name).alias("rule"), F.col(name).alias("row_count"))
            for name in rules
        ],
    )


def taxi_time(flights: DataFrame) -> DataFrame:
    """Time on the ground: elapsed less airborne minutes, by value."""
    minutes = (F.col("actual_elapsed_time") - F.col("air_time")).alias("taxi_time")
    return count_by(flights.select(minutes), "taxi_time").orderBy("taxi_time")


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First rows in a stated order."""
    return df.orderBy(*order).limit(n)
