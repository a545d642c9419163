"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import delays, figures, parsing
from skyledger.operators import marts, profile, quality, reports, sampling
from skyledger.operators.staging import register_staging, text_staging
from skyledger.plans import base, cells, moments, monthly, sketches
from skyledger.schema import FLIGHT_TYPES
from skyledger.session import configure
from skyledger.sources import landing as landing_files
from skyledger.sources import lookups as lookup_files
from skyledger.sources import tables
from skyledger.streaming.landing import load_new_files
from verification import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The selections a user of the reports would make.
YEAR, MONTH = 1997, 3
AIRPORT = "A05"

# Samples: two pairs of columns without nulls, and whole flights.
SAMPLE_SIZE = 10_000
SAMPLES = {
    "sample_pairs": ["dep_delay", "arr_delay"],
    "sample_times": ["air_time", "actual_elapsed_time"],
    "sample_flights": list(FLIGHT_TYPES),
}
# The same samples of rows as they are stored.
STORED_SAMPLES = {f"stored_{name}": name for name in SAMPLES}

# What each mart counts.
VOLUMES = {"delay_by_carrier": "total_flights"} | {k: v[0] for k, v in marts.SHOWN_BY.items()}


def query(function: Query) -> Query:
    """Register a function under its name, run with the session's settings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def _monthly_bronze(spark: SparkSession, sf_dir: str) -> str:
    path = tables.work_folder(spark, "bronze")
    tables.to_bronze(fixture.landing(spark, sf_dir, by_month=True), path)
    return path


def _monthly_silver(spark: SparkSession, sf_dir: str) -> str:
    path = tables.work_folder(spark, "silver")
    tables.replace_months(fixture.silver(spark, sf_dir, by_month=True), path)
    return path


# --- sources and sinks ------------------------------------------------------


@query
def bronze_roundtrip(spark, sf_dir):
    """Landing text written under year=/month= and read back."""
    return tables.read_bronze(spark, _monthly_bronze(spark, sf_dir))


@query
def landing_csv(spark, sf_dir):
    """Landing text as CSV files, quotes doubled, read by header."""
    path = tables.work_folder(spark, "landing")
    fixture.landing(spark, sf_dir).write.options(header=True, escape='"').csv(path)
    return landing_files.read_landing(spark, path)


@query
def lookup_publish(spark, sf_dir):
    """All six code lists as CSV files, published to parquet and read back."""
    folder, target = tables.work_folder(spark, "codes"), tables.work_folder(spark, "lookups")
    for key, codes in fixture.code_lists(spark, sf_dir).items():
        codes.write.csv(f"{folder}/{lookup_files.LOOKUP_FILES[key]}", header=True)
    published = lookup_files.publish_lookups(spark, folder, target)
    parts = [
        spark.read.parquet(f"{target}/{key}").select(
            F.lit(key).alias("list"), F.col("Code").alias("code"), F.col("Description").alias("description")
        )
        for key in published
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def missing_months(spark, sf_dir):
    """A year whose landing files lack a month: refused by default, or read without it."""
    root = tables.work_folder(spark, "landing")
    year = fixture.landing(spark, sf_dir, by_month=True).where((F.col("Year") == str(YEAR)) & (F.col("Month") != str(MONTH)))
    fixture.write_landing_files(year, root)
    months = monthly.months_between((YEAR, 1), (YEAR, 12))
    try:
        landing_files.read_landing_months(spark, root, months)
        refused = False
    except FileNotFoundError:
        refused = True
    rows = landing_files.read_landing_months(spark, root, months, "skip")
    return rows.groupBy(F.col("Month").alias("month_text")).agg(
        F.count("*").alias("flight_count"), F.lit(refused).alias("refused")
    )


def _text_table(spark: SparkSession, sf_dir: str) -> str:
    path = tables.work_folder(spark, "raw")
    for _ in range(2):
        tables.load_raw_text(fixture.landing(spark, sf_dir, by_month=True), path)
    return path


@query
def raw_text_table(spark, sf_dir):
    """Text table loaded twice: one copy of every row."""
    return tables.read_raw_text(spark, _text_table(spark, sf_dir))


@query
def scan_text_month(spark, sf_dir):
    """One month of the text table, by its Year and Month text."""
    return tables.read_raw_text(spark, _text_table(spark, sf_dir), YEAR, MONTH)


@query
def ingest_targets(spark, sf_dir):
    """Landing files of one year to all three targets, by month."""
    root = tables.work_folder(spark, "ingest")
    fixture.write_landing_files(fixture.landing(spark, sf_dir, by_month=True), root)
    names = ("bronze", "raw", "text-staging")
    bronze, raw, staging = (tables.work_folder(spark, name) for name in names)
    months = monthly.months_between((YEAR, 1), (YEAR, 12))
    monthly.ingest(spark, root, months, bronze, raw, staging)
    layers = {
        "bronze": tables.read_bronze(spark, bronze),
        "raw": tables.read_raw_text(spark, raw),
        "staging": tables.read_text_staging(spark, staging),
    }
    counted = [
        rows.groupBy(F.lit(name).alias("layer"), F.col("Month").alias("month_text")).agg(
            F.count("*").alias("flight_count"),
            F.count("ArrDelay").alias("known_delays"),
            F.sum(F.length("OriginCityName")).alias("letters"),
        )
        for name, rows in layers.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def scan_month(spark, sf_dir):
    """One month of bronze."""
    path = _monthly_bronze(spark, sf_dir)
    return tables.read_bronze_month(spark, path, YEAR, MONTH)


@query
def scan_all_months(spark, sf_dir):
    """Silver months read together."""
    silver = tables.read_silver(spark, _monthly_silver(spark, sf_dir))
    return silver.groupBy("year", "month").agg(
        F.count("*").alias("flight_count"), F.sum("distance").alias("miles")
    )


@query
def silver_rerun(spark, sf_dir):
    """All of silver loaded, then one year of it again: one copy."""
    path = _monthly_silver(spark, sf_dir)
    again = fixture.silver(spark, sf_dir).where(F.col("year") == YEAR)
    tables.replace_months(again, path, gather=True)
    return tables.read_silver(spark, path)


@query
def clustered_scan(spark, sf_dir):
    """Point look-up by the cluster keys of the clustered table."""
    path = tables.work_folder(spark, "clustered")
    tables.write_clustered(fixture.silver(spark, sf_dir), path)
    return tables.read_silver(spark, path).where(
        (F.col("reporting_airline") == "C03") & (F.col("origin") == AIRPORT)
    )


@query
def interleaved_scan(spark, sf_dir):
    """Look-up by one cluster key alone, the second, of the interleaved table."""
    path = tables.work_folder(spark, "interleaved")
    year = fixture.silver(spark, sf_dir).where(F.col("year") == YEAR)
    tables.write_interleaved(year, path, ["year"])
    return tables.read_silver(spark, path).where(F.col("origin") == AIRPORT)


@query
def clustered_day(spark, sf_dir):
    """One day of a table partitioned by flight date."""
    path = tables.work_folder(spark, "clustered-days")
    year = fixture.silver(spark, sf_dir).where(F.col("year") == YEAR)
    tables.write_clustered(year, path, ["flight_date"])
    day = tables.read_silver(spark, path).where(F.col("flight_date") == f"{YEAR}-03-15")
    return day.withColumn("flight_date", F.col("flight_date").cast("date"))


@query
def backfill(spark, sf_dir):
    """Bronze months to silver in two jobs; a third run finds nothing to do."""
    bronze, path = _monthly_bronze(spark, sf_dir), tables.work_folder(spark, "silver")
    lists = fixture.lookups(spark, sf_dir)
    monthly.load_months(spark, bronze, path, lists, end=(YEAR, 12))
    monthly.load_months(spark, bronze, path, lists)
    left_over = monthly.load_months(spark, bronze, path, lists)
    return tables.read_silver(spark, path).withColumn("left_over", F.lit(len(left_over)))


@query
def stream_landing(spark, sf_dir):
    """Landing files loaded as they are found; a second run finds none."""
    root, path = tables.work_folder(spark, "arriving"), tables.work_folder(spark, "silver")
    fixture.write_landing_files(fixture.landing(spark, sf_dir, by_month=True), root)
    ledger = tables.work_folder(spark, "loaded-files")
    for _ in range(2):
        found = load_new_files(spark, root, path, fixture.lookups(spark, sf_dir), ledger)
    return tables.read_silver(spark, path).withColumn("left_over", F.lit(len(found)))


@query
def archive_landing(spark, sf_dir):
    """ZIP archives of landing CSV, one per task that wrote them, read back."""
    folder = tables.work_folder(spark, "archives")
    fixture.write_archives(fixture.landing(spark, sf_dir), folder)
    return landing_files.read_archives(spark, folder)


# --- silver and staging -----------------------------------------------------


@query
def silver(spark, sf_dir):
    """The 33 silver columns, parsed from landing text."""
    return fixture.silver_from_text(spark, sf_dir)


@query
def stg_view(spark, sf_dir):
    """The staging view."""
    register_staging(fixture.silver(spark, sf_dir))
    return spark.table("staging_flights")


@query
def staging_pandas_rules(spark, sf_dir):
    """The text path's staging rows."""
    return text_staging(fixture.landing(spark, sf_dir))


@query
def tolerant_cast(spark, sf_dir):
    """Unreadable numbers and dates become null."""
    rows = fixture.landing(spark, sf_dir)
    number = (
        F.when(F.col("DayOfWeek") == "1", "abc")
        .when(F.col("DayOfWeek") == "2", "NaN")
        .when(F.col("DayOfWeek") == "3", "")
        .otherwise(F.col("Distance"))
    )
    day = F.when(F.col("Month") == "2", F.regexp_replace("FlightDate", "-", "")).otherwise(
        F.col("FlightDate")
    )
    flag = F.when(F.col("DayOfWeek") == "4", "").otherwise(F.col("Cancelled"))
    parsed = rows.select(
        F.col("DayOfWeek").alias("dow"),
        parsing.whole_number(number).alias("distance"),
        parsing.number(number).alias("distance_exact"),
        parsing.iso_date(day).alias("flight_date"),
        parsing.iso_date(day, ["yyyyMMdd"]).alias("flight_date_any"),
        parsing.flag(flag).alias("cancelled"),
        parsing.strict_flag(flag).alias("cancelled_strict"),
    )
    return parsed.groupBy("dow", "flight_date", "flight_date_any").agg(
        F.count("distance").alias("distances"),
        F.sum("distance").alias("miles"),
        F.sum("distance_exact").alias("miles_exact"),
        F.count("cancelled").alias("known_flags"),
        F.count_if("cancelled_strict").alias("cancelled_flights"),
    )


def _tiers(spark, sf_dir, null_as, labels=None):
    minutes = F.col("arr_delay")
    rows = fixture.source_flights(spark, sf_dir).select(
        "arr_delay",
        delays.is_delayed(minutes).alias("is_delayed"),
        delays.delay_category(minutes, null_as, labels).alias("delay_category"),
    )
    return rows.groupBy("arr_delay", "is_delayed", "delay_category").agg(
        F.count("*").alias("flight_count")
    )


@query
def delay_flags(spark, sf_dir):
    """Late flag and tier by delay, a missing delay as Severe."""
    return _tiers(spark, sf_dir, delays.LAST_TIER)


@query
def delay_category_null(spark, sf_dir):
    """Late flag and tier by delay, a missing delay without tier."""
    return _tiers(spark, sf_dir, None)


@query
def delay_category_unknown(spark, sf_dir):
    """Late flag and tier by delay under the profile's labels."""
    return _tiers(spark, sf_dir, delays.UNKNOWN, delays.PROFILE_LABELS)


@query
def hhmm_to_ts(spark, sf_dir):
    """Scheduled and actual departure as timestamps."""
    rows = fixture.source_flights(spark, sf_dir)
    return rows.groupBy(
        figures.clock_time(F.col("flight_date"), F.col("crs_dep_time")).alias("scheduled_at"),
        figures.clock_time(F.col("flight_date"), F.col("dep_time")).alias("departed_at"),
    ).agg(F.count("*").alias("flight_count"))


@query
def code_labels(spark, sf_dir):
    """Labels of reasons, weekdays and months."""
    rows = fixture.source_flights(spark, sf_dir)
    return rows.groupBy(
        figures.label(F.col("cancellation_code"), figures.CANCELLATION_LABELS).alias("reason"),
        figures.label(F.col("day_of_week"), figures.WEEKDAY_LABELS).alias("weekday"),
        figures.label(F.col("month"), figures.MONTH_NAMES).alias("month_name"),
    ).agg(F.count("*").alias("flight_count"))


# --- marts ------------------------------------------------------------------


def _register_marts() -> None:
    for name, build in marts.MARTS.items():
        QUERIES[name] = lambda spark, sf_dir, b=build: b(fixture.staging(configure(spark), sf_dir))
    for name, build in base.MARTS.items():
        QUERIES[f"{name}_from_base"] = lambda spark, sf_dir, b=build: b(
            fixture.stored_base(configure(spark), sf_dir)
        )
    for name, build in cells.MARTS.items():
        QUERIES[f"{name}_from_cells"] = lambda spark, sf_dir, b=build: b(
            fixture.stored_cells(configure(spark), sf_dir)
        )


_register_marts()


@query
def flight_base(spark, sf_dir):
    """The shared aggregate behind all six marts."""
    return base.flight_base(fixture.staging(spark, sf_dir))


@query
def top_carrier(spark, sf_dir):
    """Airline with most departures per airport."""
    return marts.top_carriers(marts.carrier_departures(fixture.staging(spark, sf_dir)))


def _mart(name: str, spark, sf_dir) -> DataFrame:
    return marts.MARTS[name](fixture.staging(spark, sf_dir))


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return (
        _mart("delay_by_carrier", spark, sf_dir),
        _mart("flights_by_carrier", spark, sf_dir),
    )


@query
def mart_ranked(spark, sf_dir):
    """The carrier mart in the order it is shown, with the place of each row."""
    mart = _mart("flights_by_carrier", spark, sf_dir)
    return reports.ranked(mart, marts.shown_order("flights_by_carrier"))


@query
def root_causes_ranked(spark, sf_dir):
    """The root-cause mart in the order it is shown, with the place of each row."""
    mart = _mart("root_causes", spark, sf_dir)
    return reports.ranked_all(mart, marts.shown_order("root_causes"))


@query
def airport_detail_ranked(spark, sf_dir):
    """The airport mart in the order it is shown, with the place of each row."""
    mart = _mart("airport_detail", spark, sf_dir)
    return reports.ranked_all(mart, marts.shown_order("airport_detail"))


@query
def mart_refresh(spark, sf_dir):
    """Marts stored from stored silver, one year refreshed; rows and volume of each."""
    silver_path, folder = _monthly_silver(spark, sf_dir), tables.work_folder(spark, "marts")
    monthly.refresh_marts(spark, silver_path, folder)
    months = monthly.months_between((YEAR, 1), (YEAR, 12))
    monthly.refresh_marts(spark, silver_path, folder, months)
    stored = monthly.read_marts(spark, folder)
    return _sums(stored)


def _sums(stored: dict[str, DataFrame]) -> DataFrame:
    """Rows and volume of stored marts."""
    parts = [
        stored[name].agg(
            F.lit(name).alias("mart"), F.count("*").alias("row_count"), F.sum(volume).alias("volume")
        )
        for name, volume in VOLUMES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def mart_rebuild(spark, sf_dir):
    """Marts stored from one reading of stored silver; rows and volume of each."""
    silver_path, folder = _monthly_silver(spark, sf_dir), tables.work_folder(spark, "marts")
    monthly.rebuild_marts(spark, silver_path, folder)
    return _sums(monthly.read_marts(spark, folder))


# --- reports ----------------------------------------------------------------


@query
def kpi(spark, sf_dir):
    """Headline figures over all years."""
    return reports.kpi(*_two(spark, sf_dir))


@query
def kpi_year(spark, sf_dir):
    """Headline figures of one year."""
    return reports.kpi(*_two(spark, sf_dir), YEAR)


@query
def worst_airline(spark, sf_dir):
    """Airline with the highest mean of monthly delays."""
    return reports.worst_airline(*_two(spark, sf_dir))


@query
def monthly_trend(spark, sf_dir):
    """Figures by calendar month over all years."""
    return reports.monthly_trend(_mart("delay_by_carrier", spark, sf_dir))


@query
def monthly_trend_year(spark, sf_dir):
    """Figures by calendar month of one year."""
    return reports.monthly_trend(_mart("delay_by_carrier", spark, sf_dir), YEAR)


@query
def airline_label(spark, sf_dir):
    """Cause shares with airline labels."""
    return reports.root_cause_chart(
        _mart("root_causes", spark, sf_dir), _mart("flights_by_carrier", spark, sf_dir)
    )


@query
def top_routes(spark, sf_dir):
    """Busiest routes of an airport."""
    return reports.top_routes(_mart("route_performance", spark, sf_dir), AIRPORT)


@query
def top_airports(spark, sf_dir):
    """Busiest airports."""
    return reports.top_airports(_mart("airport_bottlenecks", spark, sf_dir))


@query
def airport_card(spark, sf_dir):
    """Figures of one airport."""
    detail = _mart("airport_detail", spark, sf_dir)
    return reports.airport_card(detail, _mart("flights_by_carrier", spark, sf_dir), AIRPORT)


@query
def selection_lists(spark, sf_dir):
    """Airports offered for selection."""
    return reports.choices(_mart("airport_detail", spark, sf_dir), "airport_code")


# --- profile ----------------------------------------------------------------


def _register_profile() -> None:
    simple = {
        "row_counts": profile.row_counts,
        "describe": profile.describe,
        "null_profile": profile.null_profile,
        "critical_nulls": profile.critical_nulls,
        "null_by_cancelled": profile.null_by_cancelled,
        "all_null_share": profile.all_null_share,
        "distinct_values": lambda f: profile.distinct_values(f, ["year", "month", "origin"]),
        "distinct_counts": profile.distinct_counts,
        "flights_by_weekday": profile.flights_by_weekday,
        "flights_by_day": profile.flights_by_day,
        "top_airlines": lambda f: profile.top_by_count(f, "reporting_airline"),
        "top_origins": lambda f: profile.top_by_count(f, "origin"),
        "distance_stats": profile.distance_stats,
        "hist_distance": profile.distance_histogram,
        "hist_arr_delay": profile.arrival_delay_histogram,
        "departures_by_hour": profile.departures_by_hour,
        "flag_rates": profile.flag_rates,
        "cancel_reasons": profile.cancel_reasons,
        "cancel_rate_top": profile.cancel_rate_top,
        "avg_delay_top": profile.avg_delay_top,
        "category_shares": profile.category_shares,
        "cause_shares": profile.cause_shares,
        "delay_corr": profile.delay_corr,
        "outlier_counts": profile.outlier_counts,
        "taxi_time": profile.taxi_time,
        "preview": lambda f: profile.preview(f, f.columns),
        "sample_pairs": lambda f: sampling.sample_rows(f, SAMPLES["sample_pairs"], SAMPLE_SIZE),
        "sample_times": lambda f: sampling.sample_rows(f, SAMPLES["sample_times"], SAMPLE_SIZE),
        "sample_flights": lambda f: sampling.sample_rows(
            f, SAMPLES["sample_flights"], SAMPLE_SIZE, keep_nulls=True
        ),
    }
    for name, build in simple.items():
        QUERIES[name] = lambda spark, sf_dir, b=build: b(
            fixture.source_flights(configure(spark), sf_dir)
        )
    for name, like in STORED_SAMPLES.items():
        QUERIES[name] = lambda spark, sf_dir, n=like: sampling.lowest_draws(
            fixture.source_flights(configure(spark), sf_dir, draws=True),
            SAMPLES[n], SAMPLE_SIZE, keep_nulls=n == "sample_flights",
        )


_register_profile()


def _changed_year(spark, sf_dir, refresh: Callable[..., None], name: str, **options) -> str:
    """A monthly table of a first load without the year, then the year alone."""
    flights, path = fixture.source_flights(spark, sf_dir), tables.work_folder(spark, name)
    refresh(flights.where(F.col("year") != YEAR), path, **options)
    refresh(flights, path, monthly.months_between((YEAR, 1), (YEAR, 12)), **options)
    return path


@query
def distinct_counts_merged(spark, sf_dir):
    """Distinct counts of all years and of one, from sketches by month."""
    path = _changed_year(spark, sf_dir, sketches.refresh_sketches, "sketches")
    parts = [
        sketches.distinct_estimates(spark, path, year).withColumn("year", F.lit(year).cast("int"))
        for year in (None, YEAR)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def describe_merged(spark, sf_dir):
    """Column figures of one year, from sums by month."""
    path = _changed_year(spark, sf_dir, moments.refresh_moments, "moments", correlated=[])
    return moments.describe(spark, path, YEAR)


@query
def delay_corr_merged(spark, sf_dir):
    """Correlations of one year, from sums by month."""
    path = _changed_year(spark, sf_dir, moments.refresh_moments, "moments", described=[])
    return moments.correlation(spark, path, YEAR)


# --- quality ----------------------------------------------------------------


def _checked_tables(spark, sf_dir) -> dict[str, DataFrame]:
    shared = fixture.stored_cells(spark, sf_dir)
    built = {name: build(shared) for name, build in cells.MARTS.items()}
    return {"staging": fixture.staging(spark, sf_dir), **built}


@query
def dq_not_null(spark, sf_dir):
    """The 13 not-null checks."""
    return quality.not_null_suite(_checked_tables(spark, sf_dir))


@query
def dq_unique(spark, sf_dir):
    """The 4 uniqueness checks."""
    return quality.unique_suite(_checked_tables(spark, sf_dir))


@query
def dq_accepted(spark, sf_dir):
    """The accepted-values check."""
    return quality.accepted_suite(_checked_tables(spark, sf_dir))


@query
def dq_on_write(spark, sf_dir):
    """All 18 checks, counted by the jobs that write the marts."""
    silver_path, folder = _monthly_silver(spark, sf_dir), tables.work_folder(spark, "marts")
    checks = quality.WriteChecks()
    monthly.rebuild_marts(spark, silver_path, folder, checks)
    return checks.report(spark)


@query
def dq_row_counts(spark, sf_dir):
    """Rows per month of the stored text table, bronze and silver."""
    bronze, silver_path = _monthly_bronze(spark, sf_dir), tables.work_folder(spark, "silver")
    monthly.load_months(spark, bronze, silver_path, fixture.lookups(spark, sf_dir))
    text = tables.read_raw_text(spark, _text_table(spark, sf_dir)).select(
        F.col("Year").cast("int").alias("year"), F.col("Month").cast("int").alias("month")
    )
    layers = {
        "raw": text,
        "bronze": spark.read.parquet(bronze),
        "silver": tables.read_silver(spark, silver_path),
    }
    return quality.layer_row_counts(layers)
