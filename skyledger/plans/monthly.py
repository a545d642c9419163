"""Monthly loads: landing to bronze and text tables, bronze to silver, marts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators.quality import WriteChecks
from skyledger.operators.silver import build_silver
from skyledger.operators.staging import staging_view, text_staging
from skyledger.plans import base as base_marts
from skyledger.plans import cells as cell_marts
from skyledger.sources.landing import landing_months, read_landing_months
from skyledger.sources.lookups import Lookups
from skyledger.sources.tables import (
    TEXT_KEYS,
    as_landing,
    load_raw_text,
    read_bronze,
    read_silver,
    replace_all,
    replace_months,
    replace_text_months,
    stored_months,
    to_bronze,
    write_mart,
)

Month = tuple[int, int]

# Marts written at the same time.
MARTS_AT_ONCE = 4


def months_between(start: Month, end: Month) -> list[Month]:
    """Months from ``start`` to ``end``, both included."""
    first, last = start[0] * 12 + start[1] - 1, end[0] * 12 + end[1] - 1
    return [(m // 12, m % 12 + 1) for m in range(first, last + 1)]


def month_filter(months: Iterable[Month], keys: tuple[str, str] = ("year", "month")) -> Column:
    """Rows of any of the months, in a form that prunes directories."""
    of_year_key, of_month_key = keys
    by_year: dict[int, list[int]] = {}
    for year, month in sorted(set(months)):
        by_year.setdefault(year, []).append(month)
    wanted = F.lit(False)
    for year, of_year in by_year.items():
        wanted = wanted | ((F.col(of_year_key) == year) & F.col(of_month_key).isin(*of_year))
    return wanted


def ingest(
    spark: SparkSession,
    landing_root: str,
    months: list[Month],
    bronze: str,
    raw: str | None = None,
    staging: str | None = None,
    on_missing: str = "skip",
) -> None:
    """Landing files of some months to bronze and, if asked, the text tables.

    All months go through in one job per target, and each target replaces
    just those months; a month whose files hold no row is emptied.
    """
    landing = read_landing_months(spark, landing_root, months, on_missing)
    sent = set(months) & landing_months(spark, landing_root, {year for year, _ in months})
    if raw is None:
        to_bronze(landing, bronze, months=sent)
        return
    # The CSV is parsed once; the text table, which keeps all of it, feeds the rest.
    load_raw_text(landing, raw, months=sent)
    loaded = spark.read.parquet(raw).where(month_filter(months, TEXT_KEYS))
    to_bronze(as_landing(loaded), bronze, months=sent)
    if staging is not None:
        load_text_staging(as_landing(loaded), staging, sent)


def load_text_staging(raw: DataFrame, path: str, months: Iterable[Month] | None = None) -> None:
    """Text-path staging rows, months replaced."""
    replace_text_months(text_staging(raw), path, months=months)


def load_months(
    spark: SparkSession,
    bronze: str,
    silver: str,
    lookups: Lookups,
    start: Month | None = None,
    end: Month | None = None,
    reload: bool = False,
) -> list[Month]:
    """Bronze months to silver in one job; returns the months it loaded.

    Months silver already holds are left alone unless ``reload`` is set, so a
    run after an interruption picks up where the last one stopped. With
    ``reload``, months of the range that bronze no longer holds are emptied.
    Lists not counted yet are counted; where one does not fit a broadcast, its
    shuffle leaves rows in no month order and they are gathered before writing.
    """
    present = stored_months(spark, bronze)
    held = stored_months(spark, silver)

    def asked_for(month: Month) -> bool:
        return (start is None or month >= start) and (end is None or month <= end)

    chosen = set(filter(asked_for, present | held if reload else present - held))
    if not chosen:
        return []
    lists = lookups if lookups.is_counted else lookups.counted()
    rows = spark.read.parquet(bronze).where(month_filter(chosen))
    replace_months(build_silver(as_landing(rows), lists), silver, not lists.fit, chosen)
    return sorted(chosen)


def refresh_marts(
    spark: SparkSession,
    silver: str,
    folder: str,
    months: Iterable[Month] | None = None,
    checks: WriteChecks | None = None,
) -> None:
    """Rewrite the six marts, scanning only the flights of changed months.

    The base aggregate is kept as a monthly table. With ``months`` only those
    months of it are computed again, and emptied if silver holds no row of
    them; without, all of it is. The marts then roll up the whole base. ``checks``
    ride on the writes: those on staging cover the flights that were scanned.
    """
    flights = read_silver(spark, silver)
    if months is not None:
        months = set(months)
        flights = flights.where(month_filter(months))
    staging = staging_view(flights)
    base = base_marts.flight_base(checks.watch(staging, "staging") if checks else staging)
    stored = base.withColumnsRenamed({"flight_year": "year", "flight_month": "month"})
    if months is None:
        replace_all(stored, f"{folder}/flight_base")
    else:
        replace_months(stored, f"{folder}/flight_base", gather=True, months=months)
    whole = spark.read.parquet(f"{folder}/flight_base").withColumnsRenamed(
        {"year": "flight_year", "month": "flight_month"}
    )

    _write_marts(whole, base_marts.MARTS, folder, checks)


def rebuild_marts(
    spark: SparkSession, silver: str, folder: str, checks: WriteChecks | None = None
) -> None:
    """Rewrite the six marts from one reading of all flights, by grouping sets.

    For a build of everything, where no base is kept: the cells are far fewer rows.
    """
    staging = staging_view(read_silver(spark, silver))
    cells = cell_marts.mart_cells(checks.watch(staging, "staging") if checks else staging)
    cells.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/mart_cells")
    whole = spark.read.schema(cells.schema).parquet(f"{folder}/mart_cells")
    _write_marts(whole, cell_marts.MARTS, folder, checks)


def _write_marts(
    source: DataFrame, marts: Mapping[str, Callable], folder: str, checks: WriteChecks | None
) -> None:
    def write(name: str) -> None:
        mart = marts[name](source)
        write_mart(checks.watch(mart, name) if checks else mart, f"{folder}/{name}")

    # Small independent jobs: side by side, none waits for another's last task.
    with ThreadPoolExecutor(MARTS_AT_ONCE) as pool:
        list(pool.map(write, marts))


def read_marts(spark: SparkSession, folder: str, cache: bool = False) -> dict[str, DataFrame]:
    """The six stored marts, cached for a session that reads them repeatedly."""
    marts = {name: spark.read.parquet(f"{folder}/{name}") for name in base_marts.MARTS}
    return {name: mart.cache() for name, mart in marts.items()} if cache else marts


def rebuild(spark: SparkSession, bronze: str, silver: str, lookups: Lookups) -> None:
    """All of bronze to silver, every month replaced."""
    replace_months(build_silver(read_bronze(spark, bronze), lookups), silver)
