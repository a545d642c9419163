"""Figures and tables shown on top of the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.figures import MONTH_NAMES, label, percent, round_half_up
from skyledger.operators.marts import shown_order
from skyledger.sources.tables import stored

# The tiers that count as delayed.
DELAYED = ["total_minor_delayed", "total_major_delayed", "total_severe_delayed"]


def for_year(mart: DataFrame, year: int | None) -> DataFrame:
    """One year of a mart, or all of it."""
    return mart if year is None else mart.where(F.col("flight_year") == year)


def airline_names(flights_by_carrier: DataFrame) -> DataFrame:
    """One name per airline code, from the carrier mart."""
    return flights_by_carrier.groupBy("reporting_airline").agg(
        F.max("airline_name").alias("known_name")
    )


def with_airline_label(
    df: DataFrame, flights_by_carrier: DataFrame, code: str = "reporting_airline"
) -> DataFrame:
    """Adds ``airline_label``: the airline's name, or its code without one."""
    names = airline_names(flights_by_carrier).withColumnRenamed("reporting_airline", "known_code")
    return (
        df.join(names, F.col(code) == F.col("known_code"), "left")
        .withColumn("airline_label", F.coalesce("known_name", F.col(code)))
        .drop("known_code", "known_name")
    )


def _airline_means(delay_by_carrier: DataFrame) -> DataFrame:
    # Decimal sums do not depend on the order the months are added in.
    monthly = F.col("avg_arr_delay_mins").cast("decimal(18,2)")
    mean = F.try_divide(F.sum(monthly).cast("double"), F.count(monthly))
    return delay_by_carrier.groupBy("reporting_airline").agg(
        round_half_up(mean, 6).alias("mean_arr_delay_mins"),
        F.sum("total_flights").alias("flights"),
        F.sum(sum((F.col(c) for c in DELAYED), F.lit(0))).alias("delayed"),
        F.sum("total_cancelled_flights").alias("cancelled"),
    )


def worst_airline(
    delay_by_carrier: DataFrame, flights_by_carrier: DataFrame, year: int | None = None
) -> DataFrame:
    """Airline with the highest mean of its monthly average arrival delays.

    The mean is over months, not flights, and over averages as the mart
    rounds them. The lower code wins a tie.
    """
    means = _airline_means(for_year(delay_by_carrier, year)).select(
        "reporting_airline", "mean_arr_delay_mins"
    )
    worst = (
        means.where(F.col("mean_arr_delay_mins").isNotNull())
        .orderBy(F.desc("mean_arr_delay_mins"), F.asc("reporting_airline"))
        .limit(1)
    )
    return with_airline_label(worst, flights_by_carrier)


def kpi(
    delay_by_carrier: DataFrame, flights_by_carrier: DataFrame, year: int | None = None
) -> DataFrame:
    """One row: flights, delay rate, cancellation rate, worst airline."""
    airlines = with_airline_label(
        _airline_means(for_year(delay_by_carrier, year)), flights_by_carrier
    )
    worst_first = F.when(
        F.col("mean_arr_delay_mins").isNotNull(),
        F.struct(-F.col("mean_arr_delay_mins"), F.col("reporting_airline")),
    )
    flights = F.coalesce(F.sum("flights"), F.lit(0))

    def rate(part: str) -> Column:
        return F.when(flights == 0, F.lit(0.0)).otherwise(
            percent(F.sum(part), F.sum("flights"), 1)
        )

    return airlines.agg(
        flights.alias("total_flights"),
        rate("delayed").alias("delay_rate_pct"),
        rate("cancelled").alias("cancel_rate_pct"),
        F.min_by("airline_label", worst_first).alias("worst_airline"),
    )


def monthly_trend(delay_by_carrier: DataFrame, year: int | None = None) -> DataFrame:
    """Flights, tier totals and rates by calendar month."""
    sums = (
        for_year(delay_by_carrier, year)
        .groupBy("flight_month")
        .agg(
            F.sum("total_flights").alias("total_flights"),
            F.sum("total_minor_delayed").alias("total_minor"),
            F.sum("total_major_delayed").alias("total_major"),
            F.sum("total_severe_delayed").alias("total_severe"),
            F.sum("total_cancelled_flights").alias("total_cancelled"),
        )
    )
    delayed = F.col("total_minor") + F.col("total_major") + F.col("total_severe")
    return sums.withColumns(
        {
            "delay_rate_pct": percent(delayed, F.col("total_flights"), 1),
            "cancel_rate_pct": percent(F.col("total_cancelled"), F.col("total_flights"), 2),
            "month_name": label(F.col("flight_month"), MONTH_NAMES),
        }
    ).orderBy("flight_month")


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in the given order.

    One task ranks all rows: for results cut by a limit, or kept at one row
    per airline, not for tables that grow with the flights.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def ranked_all(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The same for tables of any size: a distributed sort, and places by partition.

    The sorted rows are stored, so that counting a partition and numbering its
    rows see the same ones. Only the counts, one row a partition, meet in a task.
    """
    numbered = df.orderBy(*order).withColumn("sorted_id", F.monotonically_increasing_id())
    rows = stored(numbered, "ranked").withColumn("part", F.shiftright("sorted_id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").count()
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.col("sorted_id") - F.shiftleft("part", 33) + F.col("offset") + 1
    return rows.join(offsets, "part").select(*df.columns, place.cast("int").alias(name))


def top_routes(route_performance: DataFrame, origin: str, n: int = 20) -> DataFrame:
    """Busiest routes out of an airport."""
    order = shown_order("route_performance")
    best = route_performance.where(F.col("origin") == origin).orderBy(*order).limit(n)
    return ranked(best, order).select(
        "place", "origin", "dest", "total_flights", "avg_air_time_mins", "cancellation_rate_pct"
    )


def top_airports(airport_bottlenecks: DataFrame, n: int = 10) -> DataFrame:
    """Busiest airports, with their place by traffic and by lowest arrival delay."""
    order = shown_order("airport_bottlenecks")
    best = airport_bottlenecks.orderBy(*order).limit(n)
    by_delay = [F.asc_nulls_last("avg_arr_delay_mins"), F.asc("airport_code"), F.asc("city_name")]
    return ranked(ranked(best, order), by_delay, "place_by_delay").select(
        "place",
        "place_by_delay",
        "airport_code",
        "city_name",
        "total_traffic",
        "avg_taxi_out_mins",
        "avg_arr_delay_mins",
    )


def airport_card(
    airport_detail: DataFrame, flights_by_carrier: DataFrame, airport: str
) -> DataFrame:
    """The figures of one airport; the row with most traffic if it has several."""
    one = airport_detail.where(F.col("airport_code") == airport)
    row = one.orderBy(*shown_order("airport_detail")).limit(1)
    shown = row.select(
        "airport_code",
        "city_name",
        "total_traffic",
        "total_departures",
        "total_arrivals",
        *[
            round_half_up(F.col(c), 1).alias(c)
            for c in (
                "avg_taxi_out_mins",
                "avg_taxi_in_mins",
                "avg_dep_delay_mins",
                "avg_arr_delay_mins",
            )
        ],
        "total_diverted",
        "top_carrier",
    )
    named = with_airline_label(shown, flights_by_carrier, code="top_carrier")
    return named.drop("top_carrier").withColumnRenamed("airline_label", "top_carrier")


def root_cause_chart(root_causes: DataFrame, flights_by_carrier: DataFrame) -> DataFrame:
    """Cause shares by airline, most delayed flights first."""
    labelled = with_airline_label(root_causes, flights_by_carrier)
    return labelled.orderBy(*shown_order("root_causes"))


def carrier_chart(flights_by_carrier: DataFrame) -> DataFrame:
    """Flights and diversion rate by airline, most flights first."""
    return flights_by_carrier.orderBy(*shown_order("flights_by_carrier"))


def choices(mart: DataFrame, column: str) -> DataFrame:
    """The values offered for a selection, in order."""
    return mart.select(column).distinct().orderBy(column)
