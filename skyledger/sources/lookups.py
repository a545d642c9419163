"""Code lists: reading, publishing, checking and joining them."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.schema import LOOKUP_FILES
from skyledger.sources.landing import CSV_OPTIONS, is_present

log = logging.getLogger(__name__)

# A lookup is broadcast only when it was counted and stays under both.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A ``Code,Description`` file under the given names."""
    raw = spark.read.schema("Code string, Description string").csv(
        path, **CSV_OPTIONS, enforceSchema=False
    )
    return raw.select(F.col("Code").alias(key), F.col("Description").alias(value))


def publish_lookups(
    spark: SparkSession, folder: str, target: str, files: dict[str, str] = LOOKUP_FILES
) -> list[str]:
    """Copy the lookup files that exist to parquet; name the ones written."""
    written = []
    for key, filename in files.items():
        path = f"{folder}/{filename}"
        if not is_present(spark, path):
            log.warning("lookup file not found, skipped: %s", path)
            continue
        read_lookup(spark, path, "Code", "Description").write.mode("overwrite").parquet(
            f"{target}/{key}"
        )
        written.append(key)
    return written


@dataclass(frozen=True)
class Lookup:
    """A code list with what was counted about it."""

    frame: DataFrame
    code: str
    name: str
    rows: int | None = None
    repeated: int | None = None
    size: int | None = None

    @property
    def fits(self) -> bool:
        """Counted, and small enough to be sent to every executor."""
        return (
            self.rows is not None
            and self.rows <= BROADCAST_ROWS
            and self.size <= BROADCAST_BYTES
        )

    def join_to(self, flights: DataFrame, key: str) -> DataFrame:
        """Left join on ``flights[key]``, adding the name column.

        A list that does not fit is joined by shuffle, where adaptive
        execution splits the tasks of a key that holds many of the flights
        (the flight side of a left join may be split).
        """
        side = F.broadcast(self.frame) if self.fits else self.frame
        joined = flights.join(side, flights[key] == side[self.code], "left")
        return joined.drop(self.code)


@dataclass(frozen=True)
class Lookups:
    """The three code lists the silver step joins."""

    carriers: Lookup
    airports: Lookup
    cancellation: Lookup

    @property
    def is_counted(self) -> bool:
        return all(x.rows is not None for x in (self.carriers, self.airports, self.cancellation))

    @property
    def fit(self) -> bool:
        """Whether all are broadcast, so that silver has no shuffle."""
        return all(x.fits for x in (self.carriers, self.airports, self.cancellation))

    @classmethod
    def of(
        cls, carriers: DataFrame, airports: DataFrame, cancellation: DataFrame
    ) -> Lookups:
        """From frames with the columns code and name, in that order."""
        return cls(
            Lookup(carriers, *carriers.columns),
            Lookup(airports, *airports.columns),
            Lookup(cancellation, *cancellation.columns),
        )

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Lookups:
        """From the CSV files in a folder."""
        paths = {key: f"{folder}/{LOOKUP_FILES[key]}" for key in cls.__annotations__}
        return cls.of(
            read_lookup(spark, paths["carriers"], "carrier_code", "airline_name"),
            read_lookup(spark, paths["airports"], "airport_code", "origin_airport_name"),
            read_lookup(spark, paths["cancellation"], "cancel_code", "cancellation_reason"),
        )

    def counted(self) -> Lookups:
        """The same lists with rows, repeated codes and bytes, in one job.

        A repeated code multiplies the flights that carry it, so it is logged;
        the join itself is left as it is.
        """
        names = list(type(self).__annotations__)
        per_code = [self._per_code(name) for name in names]
        counts = (
            reduce(DataFrame.unionByName, [p.drop(p.columns[0]) for p in per_code])
            .groupBy("list")
            .agg(
                F.sum("n").alias("rows"),
                F.count_if(F.col("n") > 1).alias("repeated"),
                F.sum("bytes").alias("bytes"),
            )
            .collect()
        )
        changes = {}
        found = {row["list"]: row for row in counts}
        for name in names:
            row = found.get(name)
            rows, repeated, size = (row["rows"], row["repeated"], row["bytes"]) if row else (0, 0, 0)
            if repeated:
                log.warning("lookup %s repeats %d codes; their flights multiply", name, repeated)
            changes[name] = replace(getattr(self, name), rows=rows, repeated=repeated, size=size)
        return replace(self, **changes)

    def _per_code(self, name: str) -> DataFrame:
        """Occurrences and rough size in memory of each code of one list."""
        lookup: Lookup = getattr(self, name)
        text = F.coalesce(F.length(lookup.code), F.lit(0)) + F.coalesce(
            F.length(lookup.name), F.lit(0)
        )
        return lookup.frame.groupBy(lookup.code).agg(
            F.lit(name).alias("list"),
            F.count("*").alias("n"),
            F.sum(text * 4 + 32).alias("bytes"),
        )
