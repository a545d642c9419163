"""The six marts, each straight from the staging rows.

Every aggregate here combines on the map side, so what is shuffled is one row
per key and task, however many flights a hub airport or big carrier has, and every
mart reads the flights once. ``skyledger.plans.base`` builds all six from one shared
aggregate by month, ``skyledger.plans.cells`` from one set of partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.delays import CATEGORIES, arrived_late
from skyledger.functions.figures import flag_total, mean, percent, round_half_up
from skyledger.schema import CAUSES

# Count column of each delay tier.
TIER_COUNTS = dict(
    zip(
        [
            "total_on_time_flights",
            "total_minor_delayed",
            "total_major_delayed",
            "total_severe_delayed",
        ],
        CATEGORIES,
    )
)
MONTH_CARRIER = ["flight_year", "flight_month", "reporting_airline"]
CARRIER = ["reporting_airline", "airline_name"]
ROUTE = ["origin", "origin_city_name", "dest", "dest_city_name"]


def _average(column: str) -> Column:
    return round_half_up(F.avg(column), 2)


def delay_by_carrier(staging: DataFrame) -> DataFrame:
    """Volume, rates, average delays and tier counts by year, month and airline."""
    cancelled, diverted, flights = flag_total(F.col("cancelled")), flag_total(F.col("diverted")), F.count("*")
    return staging.groupBy(*MONTH_CARRIER).agg(
        flights.alias("total_flights"),
        cancelled.alias("total_cancelled_flights"),
        percent(cancelled, flights).alias("cancellation_rate_pct"),
        diverted.alias("total_diverted_flights"),
        percent(diverted, flights).alias("diverted_rate_pct"),
        _average("dep_delay").alias("avg_dep_delay_mins"),
        _average("arr_delay").alias("avg_arr_delay_mins"),
        *[
            F.count_if(F.col("delay_category") == tier).alias(name)
            for name, tier in TIER_COUNTS.items()
        ],
    )


def root_causes(staging: DataFrame) -> DataFrame:
    """Share of each cause in the delay minutes, over flights that arrived late."""
    minutes = F.sum("arr_delay")
    return (
        staging.where(arrived_late(F.col("arr_delay")))
        .groupBy(*CARRIER)
        .agg(
            F.count("*").alias("total_delayed_flights"),
            minutes.alias("total_delay_minutes"),
            *[percent(F.sum(cause), minutes).alias(f"{cause}_pct") for cause in CAUSES],
        )
    )


def flights_by_carrier(staging: DataFrame) -> DataFrame:
    """Flights and diversions by airline."""
    flights, diverted = F.count("*"), flag_total(F.col("diverted"))
    return staging.groupBy(*CARRIER).agg(
        flights.alias("total_flights"),
        diverted.alias("total_diverted_flights"),
        percent(diverted, flights).alias("diverted_rate_pct"),
    )


def route_performance(staging: DataFrame) -> DataFrame:
    """Volume, air time, cancellations and delays by origin and destination."""
    flights, cancelled = F.count("*"), flag_total(F.col("cancelled"))
    return staging.groupBy(*ROUTE).agg(
        flights.alias("total_flights"),
        _average("air_time").alias("avg_air_time_mins"),
        cancelled.alias("total_cancelled"),
        percent(cancelled, flights).alias("cancellation_rate_pct"),
        _average("dep_delay").alias("avg_dep_delay_mins"),
        _average("arr_delay").alias("avg_arr_delay_mins"),
    )


def departures(staging: DataFrame) -> DataFrame:
    """Departing side of an airport, by airport and city spelling."""
    return staging.groupBy(
        F.col("origin").alias("airport_code"), F.col("origin_city_name").alias("city_name")
    ).agg(
        F.count("*").alias("total_departures"),
        _average("taxi_out").alias("avg_taxi_out_mins"),
        _average("dep_delay").alias("avg_dep_delay_mins"),
        flag_total(F.col("diverted")).alias("total_diverted"),
    )


def arrivals(staging: DataFrame, by_city: bool) -> DataFrame:
    """Arriving side of an airport, by airport and, if asked, city spelling."""
    keys = [F.col("dest").alias("airport_code")]
    if by_city:
        keys.append(F.col("dest_city_name").alias("city_name"))
    return staging.groupBy(*keys).agg(
        F.count("*").alias("total_arrivals"),
        _average("taxi_in").alias("avg_taxi_in_mins"),
        _average("arr_delay").alias("avg_arr_delay_mins"),
    )


def carrier_departures(staging: DataFrame) -> DataFrame:
    """Departures by airport and airline."""
    return staging.groupBy(F.col("origin").alias("airport_code"), "reporting_airline").agg(
        F.count("*").alias("flight_count")
    )


def top_carriers(counts: DataFrame) -> DataFrame:
    """Airline with most departures per airport, the lower code on a tie.

    Ranks rows already counted by airport and airline, and Spark keeps only
    the first of each airport before the shuffle.
    """
    busiest = Window.partitionBy("airport_code").orderBy(
        F.desc("flight_count"), F.asc("reporting_airline")
    )
    return (
        counts.withColumn("place", F.row_number().over(busiest))
        .where(F.col("place") == 1)
        .select("airport_code", F.col("reporting_airline").alias("top_carrier"), "flight_count")
    )


# The groups that make up the two sides of an airport, and what is added up in them.
LEAVING, ARRIVING = ["origin", "origin_city_name"], ["dest"]
ARRIVING_CITY, AIRPORT_CARRIER = ["dest", "dest_city_name"], ["origin", "reporting_airline"]
AVERAGED_SIDES = ["taxi_out", "taxi_in", "dep_delay", "arr_delay"]
SIDE_SUMS = ["flights", "taxi_sum", "taxi_n", "delay_sum", "delay_n", "diverted"]
# Group key, city or airline, and the columns averaged, by side.
ROLES = {
    "leaving": ("origin", "origin_city_name", "taxi_out", "dep_delay"),
    "arriving": ("dest", "dest_city_name", "taxi_in", "arr_delay"),
    "carrier": ("origin", "reporting_airline", "taxi_out", "dep_delay"),
}


def grouping_sets(rows: DataFrame, sets: dict[str, list[str]], sums: list[Column]) -> DataFrame:
    """One aggregate over several groupings; ``cell`` names the one a row belongs to.

    Every row counts once per grouping where it is read, and only partial sums are
    shuffled. Keys that are not of a row's grouping are null; a null among those that
    are is a group of its own.
    """
    keys = list(dict.fromkeys(key for kept in sets.values() for key in kept))
    last = len(keys) - 1
    # Spark's number of a grouping: a bit for every key left out, the first key highest.
    number = {name: sum(1 << (last - k) for k, key in enumerate(keys) if key not in kept) for name, kept in sets.items()}
    grouped = rows.groupingSets([[F.col(key) for key in kept] for kept in sets.values()], *keys)
    named = F.create_map(*[F.lit(x) for name in sets for x in (number[name], name)])
    counted = grouped.agg(F.grouping_id().cast("int").alias("set"), *sums)
    return counted.withColumn("cell", named[F.col("set")]).drop("set")


def side_measures() -> list[Column]:
    """What both airport marts add up, over staging rows."""
    return [
        F.count("*").alias("flights"),
        flag_total(F.col("diverted")).alias("diverted"),
        *[F.sum(c).alias(f"{c}_sum") for c in AVERAGED_SIDES],
        *[F.count(c).alias(f"{c}_n") for c in AVERAGED_SIDES],
    ]


def airport_sums(rows: DataFrame, sums: list[Column], cities: bool, leaders: bool) -> DataFrame:
    """Both sides of every airport, from one reading of the rows.

    Arrivals are summed by city only if ``cities``, departures by airline, too, if
    ``leaders`` are asked for.
    """
    sets = {"leaving": LEAVING, "arriving": ARRIVING_CITY if cities else ARRIVING}
    if leaders:
        sets["carrier"] = AIRPORT_CARRIER
    return sides(grouping_sets(rows, sets, sums), {name: name for name in sets})


def sides(cells: DataFrame, cell_of: dict[str, str]) -> DataFrame:
    """The sides of every airport from finished groups, named per side by ``cell_of``."""

    def by_side(column: Callable[[str], Column]) -> Column:
        chosen = F.lit(None)
        for side, cell in cell_of.items():
            chosen = F.when(F.col("cell") == cell, column(side)).otherwise(chosen)
        return chosen

    def key(side: str, place: int) -> Column:
        name = ROLES[side][place]
        return F.col(name) if name in cells.columns else F.lit(None).cast("string")

    def average(side: str, place: int, part: str) -> Column:
        return F.col(f"{ROLES[side][place]}_{part}")

    return meeting(
        cells.where(F.col("cell").isin(*cell_of.values())).select(
            by_side(F.lit).alias("side"),
            by_side(lambda s: key(s, 0)).alias("airport_code"),
            by_side(lambda s: key(s, 1)).alias("part"),
            "flights",
            *[by_side(lambda s, x=x: average(s, 2, x)).alias(f"taxi_{x}") for x in ("sum", "n")],
            *[by_side(lambda s, x=x: average(s, 3, x)).alias(f"delay_{x}") for x in ("sum", "n")],
            "diverted",
        )
    )


def meeting(sums: DataFrame) -> DataFrame:
    """A row an airport from finished sums by airport, side and part."""

    def listed(side: str) -> Column:
        return F.collect_list(F.when(F.col("side") == side, F.struct("part", *SIDE_SUMS)))

    is_carrier = F.col("side") == "carrier"
    busiest = F.when(is_carrier, F.struct(-F.col("flights"), F.col("part")))
    return sums.groupBy("airport_code").agg(
        listed("leaving").alias("leaving"),
        listed("arriving").alias("arriving"),
        F.min_by("part", busiest).alias("top_carrier"),
    )


def airport_rows(sides: DataFrame) -> DataFrame:
    """Every leaving side ``d`` with every arriving side ``a`` of its airport.

    The sides meet on the airport alone: one with two city spellings stays two rows,
    as in the definition. A side without the other stays; flights of no airport have
    nothing to meet.
    """
    side = sides.schema["leaving"].dataType.elementType.simpleString()
    empty = F.lit(None).cast(side)

    def pair(d: Column, a: Column) -> Column:
        return F.struct(d.alias("d"), a.alias("a"))

    def some(column: str) -> Column:
        return F.when(F.size(column) == 0, F.array(empty)).otherwise(F.col(column))

    met = F.flatten(F.transform(some("leaving"), lambda d: F.transform(some("arriving"), lambda a: pair(d, a))))
    unmet = F.concat(
        F.transform("leaving", lambda d: pair(d, empty)), F.transform("arriving", lambda a: pair(empty, a))
    )
    known = F.col("airport_code").isNotNull()
    pairs = F.when(known, met).otherwise(unmet)
    return sides.select("airport_code", F.when(known, F.col("top_carrier")).alias("top_carrier"), F.inline(pairs))


def bottlenecks_of(sides: DataFrame) -> DataFrame:
    """The bottleneck mart from the sides of the airports."""
    out_count, in_count = (F.coalesce(f"{x}.flights", F.lit(0).cast("bigint")) for x in "da")
    return airport_rows(sides).select(
        "airport_code",
        F.coalesce("d.part", "a.part").alias("city_name"),
        out_count.alias("total_departures"),
        in_count.alias("total_arrivals"),
        (out_count + in_count).alias("total_traffic"),
        mean(F.col("d.taxi_sum"), F.col("d.taxi_n")).alias("avg_taxi_out_mins"),
        mean(F.col("d.delay_sum"), F.col("d.delay_n")).alias("avg_dep_delay_mins"),
        mean(F.col("a.taxi_sum"), F.col("a.taxi_n")).alias("avg_taxi_in_mins"),
        mean(F.col("a.delay_sum"), F.col("a.delay_n")).alias("avg_arr_delay_mins"),
    )


def detail_of(sides: DataFrame) -> DataFrame:
    """The detail mart from the sides of the airports; the city is the departing one only."""
    out_count, in_count = (F.coalesce(f"{x}.flights", F.lit(0).cast("bigint")) for x in "da")
    return airport_rows(sides).select(
        "airport_code",
        F.col("d.part").alias("city_name"),
        out_count.alias("total_departures"),
        in_count.alias("total_arrivals"),
        (out_count + in_count).alias("total_traffic"),
        mean(F.col("d.taxi_sum"), F.col("d.taxi_n")).alias("avg_taxi_out_mins"),
        mean(F.col("a.taxi_sum"), F.col("a.taxi_n")).alias("avg_taxi_in_mins"),
        mean(F.col("d.delay_sum"), F.col("d.delay_n")).alias("avg_dep_delay_mins"),
        mean(F.col("a.delay_sum"), F.col("a.delay_n")).alias("avg_arr_delay_mins"),
        F.coalesce("d.diverted", F.lit(0).cast("bigint")).alias("total_diverted"),
        "top_carrier",
    )


def airport_bottlenecks(staging: DataFrame) -> DataFrame:
    """Traffic, taxi times and delays by airport."""
    return bottlenecks_of(airport_sums(staging, side_measures(), cities=True, leaders=False))


def airport_detail(staging: DataFrame) -> DataFrame:
    """Traffic, taxi times, delays, diversions and top carrier by airport."""
    return detail_of(airport_sums(staging, side_measures(), cities=False, leaders=True))


# Order in which a mart is shown, busiest first; codes settle ties.
SHOWN_BY = {
    "root_causes": ["total_delayed_flights", "reporting_airline", "airline_name"],
    "flights_by_carrier": ["total_flights", "reporting_airline", "airline_name"],
    "airport_bottlenecks": ["total_traffic", "airport_code", "city_name"],
    "airport_detail": ["total_traffic", "airport_code", "city_name"],
    "route_performance": ["total_flights", *ROUTE],
}

MARTS = {
    "delay_by_carrier": delay_by_carrier,
    "root_causes": root_causes,
    "flights_by_carrier": flights_by_carrier,
    "airport_bottlenecks": airport_bottlenecks,
    "airport_detail": airport_detail,
    "route_performance": route_performance,
}


def shown_order(name: str) -> list[Column]:
    """Sort keys of a mart."""
    volume, *ties = SHOWN_BY[name]
    return [F.desc(volume), *[F.asc(c) for c in ties]]


def ordered(mart: DataFrame, name: str) -> DataFrame:
    """A mart in the order it is shown, by a distributed sort."""
    return mart.orderBy(*shown_order(name))
