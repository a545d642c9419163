"""New and corrected landing files, their months replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.operators.silver import build_silver
from skyledger.plans.monthly import Month
from skyledger.sources.landing import is_present, landing_files, read_landing_months
from skyledger.sources.lookups import Lookups
from skyledger.sources.tables import replace_months, stored

LOADED = "path string, modified timestamp, length bigint"


def _loaded(spark: SparkSession, ledger: str) -> DataFrame:
    """Every state of a file that was loaded."""
    if not is_present(spark, ledger):
        return spark.createDataFrame([], LOADED)
    return spark.read.schema(LOADED).parquet(ledger)


def load_new_files(
    spark: SparkSession,
    landing_root: str,
    silver: str,
    lookups: Lookups,
    ledger: str,
    ignore: str | None = None,
) -> list[Month]:
    """Load the months of files that are new or changed since the last run.

    A corrected month comes under the name it had before, which a file stream
    does not read again, and a file may arrive with an old time, which a stream
    passes over. So the files are compared with a ledger of (path, modification
    time, length); any state of a file not in it makes its month be read again,
    from all of its files, and replaced. Files that are gone change nothing.

    The states found are stored before anything is read, and these very states are
    written to the ledger after silver: a file that changes during the load is found
    again by the next run, and one broken off in between loads the same months again,
    which leaves one copy. File names stay in tables; only months reach the driver.
    """
    files = landing_files(spark, landing_root, ignore=ignore)
    changed = files.join(_loaded(spark, ledger), ["path", "modified", "length"], "left_anti")
    states = stored(changed.select("path", "modified", "length", "year", "month"), "changed-files")
    months = sorted((row.year, row.month) for row in states.select("year", "month").distinct().collect())
    if not months:
        return []
    lists = lookups if lookups.is_counted else lookups.counted()
    landing = read_landing_months(spark, landing_root, months, ignore=ignore)
    replace_months(build_silver(landing, lists), silver, not lists.fit, months)
    states.select("path", "modified", "length").write.mode("append").parquet(ledger)
    return months
