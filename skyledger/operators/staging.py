"""The staging view over silver, and the staging rows of the text path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.delays import delay_category
from skyledger.functions.parsing import iso_date, number, strict_flag
from skyledger.schema import LANDING_COLUMNS, MONTH_KEYS, STAGING_COLUMNS, staging_type


def staging_view(silver: DataFrame) -> DataFrame:
    """30 of the silver columns, year and month under their flight names."""
    renamed = silver.withColumnsRenamed({key: f"flight_{key}" for key in MONTH_KEYS})
    return renamed.select(*STAGING_COLUMNS)


def register_staging(silver: DataFrame, name: str = "staging_flights") -> DataFrame:
    """The staging rows as a temporary view."""
    staging = staging_view(silver)
    staging.createOrReplaceTempView(name)
    return staging


def text_staging(raw: DataFrame) -> DataFrame:
    """The text path: dates, numbers and strict flags parsed, causes kept null.

    Column names stay those of the landing file; a missing delay has no tier.
    """
    parsers = {"DATE": iso_date, "DOUBLE": number, "BOOLEAN": strict_flag, "STRING": lambda c: c}
    return raw.select(
        *[parsers[staging_type(c)](F.col(c)).alias(c) for c in LANDING_COLUMNS],
        delay_category(number(F.col("ArrDelay")), null_as=None).alias("delay_category"),
    )
