"""Flights derived from the star-schema test tables.

One SQL text, in integer arithmetic only, is run by Spark over ``lineitem``
and by the checking engine over the same file. Queries on landing files and on
parsing start from the same values turned to landing text.
"""

from __future__ import annotations

import contextlib
import zipfile

import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.figures import MONTH_NAMES, WEEKDAY_LABELS, label
from skyledger.operators.sampling import with_draw
from skyledger.operators.silver import build_silver, enriched, filled
from skyledger.operators.staging import staging_view
from skyledger.schema import FLIGHT_COLUMNS
from skyledger.plans.base import flight_base
from skyledger.plans.cells import mart_cells
from skyledger.sources.lookups import Lookups
from skyledger.sources.tables import gathered, stored

FLIGHTS = """
with b as (
  select l_orderkey as ok, l_partkey as pk, l_suppkey as sk, l_linenumber as ln,
         cast(l_quantity as int) as q, l_returnflag as rf, cast(l_shipdate as date) as d{KEEP}
  from {LINEITEM}),
k as (
  select *, (rf = 'R' and q <= 3) as canc, (rf = 'A' and q = 50) as divd,
         cast(pk % 40 as int) as oi, cast(1 + ok % 41 as int) as di,
         cast((pk % 90) - 20 + case when q > 45 then 120 else 0 end as int) as dd,
         cast(30 + (sk * 13 + pk) % 300 as int) as airt,
         cast((ok % 24) * 60 + (ln * 7) % 60 as int) as dm from b),
m as (
  select *, airt + q % 20 + ln + 11 as el, canc or divd as noarr,
         case when canc or divd then null when ok % 997 = 0 then dd + 700
              when ok % 991 = 1 then -150 else dd + (ln * 5 % 17) - 8 end as ad from k),
t as (
  select *, (dm + dd + 1440) % 1440 as dt, (dm + dd + el + 1440) % 1440 as art,
         (dm + el - (ln * 5 % 17) + 8 + 1440) % 1440 as cat from m)
select
  cast(year(d) as int) as year, cast(month(d) as int) as month,
  cast({DOW} as int) as day_of_week, d as flight_date,
  concat('C', lpad(cast(sk % 15 as {STR}), 2, '0')) as reporting_airline,
  concat('A', lpad(cast(oi as {STR}), 2, '0')) as origin,
  case when ok % 50 = 7 then concat('City "', cast(oi as {STR}), '", NY')
       else concat('City ', cast(oi as {STR})) end as origin_city_name,
  concat('A', lpad(cast(di as {STR}), 2, '0')) as dest,
  case when pk % 50 = 7 then concat('City "', cast(di as {STR}), '", NY')
       else concat('City ', cast(di as {STR})) end as dest_city_name,
  cast((dm {DIV} 60) * 100 + dm % 60 as int) as crs_dep_time,
  cast(case when not canc then (dt {DIV} 60) * 100 + dt % 60 end as int) as dep_time,
  case when not canc then dd end as dep_delay,
  cast(case when not canc then 8 + q % 20 end as int) as taxi_out,
  cast(case when not noarr then 3 + ln end as int) as taxi_in,
  cast((cat {DIV} 60) * 100 + cat % 60 as int) as crs_arr_time,
  cast(case when not noarr then (art {DIV} 60) * 100 + art % 60 end as int) as arr_time,
  cast(ad as int) as arr_delay, canc as cancelled,
  case when canc then substr('ABCD', cast(1 + ln % 4 as int), 1) end as cancellation_code,
  divd as diverted,
  cast(case when not noarr then el end as int) as actual_elapsed_time,
  case when not noarr then airt end as air_time,
  cast(case when ok % 983 = 0 then 0 else airt * 8 end as int) as distance,
  cast(case when ad >= 15 then ad {DIV} 3 end as int) as carrier_delay,
  cast(case when ad >= 15 then ad {DIV} 10 end as int) as weather_delay,
  cast(case when ad >= 15 then ad {DIV} 5 end as int) as nas_delay,
  cast(case when ad >= 15 then ad {DIV} 100 end as int) as security_delay,
  cast(case when ad >= 15
       then ad - ad {DIV} 3 - ad {DIV} 10 - ad {DIV} 5 - ad {DIV} 100 end as int)
    as late_aircraft_delay{KEEP}
from t
"""

SPARK_MARKS = {"DOW": "weekday(d) + 1", "STR": "string", "DIV": "div"}
ORACLE_MARKS = {"DOW": "isodow(d)", "STR": "varchar", "DIV": "//"}


def flights_sql(marks: dict[str, str], lineitem: str, keep: str = "") -> str:
    """The flight query in one engine's spelling, with a further column if asked."""
    return FLIGHTS.format(LINEITEM=lineitem, KEEP=f", {keep}" if keep else "", **marks)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_flights(
    spark: SparkSession, sf_dir: str, draws: bool = False, by_month: bool = False
) -> DataFrame:
    """Typed flights as derived, before they become landing text.

    The file is one row group, read by one task; its rows are dealt out first, so that
    all tasks derive flights. With ``by_month`` that brings the rows of a month together,
    as monthly files have them: seven short columns are shuffled, not the 28 of a flight.
    With ``draws`` every flight has the ``draw`` of its row, and stays where it was read.
    """
    rows = table(spark, sf_dir, "lineitem")
    if draws:
        drawn = with_draw(rows, file=F.col("_metadata.file_name"))
        return spark.sql(flights_sql(SPARK_MARKS, "{lineitem}", "draw"), lineitem=drawn)
    used = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    if by_month:
        day = F.col("l_shipdate")
        dealt = gathered(rows.select(*used, F.year(day).alias("y"), F.month(day).alias("m")), "y", "m")
    else:
        dealt = rows.select(*used).repartition("l_orderkey", "l_linenumber")
    return spark.sql(flights_sql(SPARK_MARKS, "{lineitem}"), lineitem=dealt)


def landing(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    """The flights as landing text: ``12.00`` for measures and flags."""
    decimal_text = {"dep_delay", "taxi_out", "taxi_in", "arr_delay", "air_time", "distance"}

    def text(name: str, kind: str):
        if kind == "boolean":
            return F.when(F.col(name), "1.00").when(~F.col(name), "0.00")
        if name in decimal_text or name.endswith("_delay"):
            return F.concat(F.col(name).cast("string"), F.lit(".00"))
        return F.col(name).cast("string")

    flights = source_flights(spark, sf_dir, by_month=by_month)
    return flights.select(*[text(name, kind).alias(src) for src, name, kind in FLIGHT_COLUMNS])


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """Code lists from the supplier and part tables, with gaps."""

    def codes(keys: DataFrame, letter: str, wide: int, what: str, left_out: int) -> DataFrame:
        numbers = keys.select((F.col("k") % wide).alias("n")).where(F.col("n") != left_out)
        return numbers.groupBy("n").agg(F.lit(1)).select(
            F.concat(F.lit(letter), F.lpad(F.col("n").cast("string"), 2, "0")),
            F.concat(F.lit(f"{what} "), F.col("n").cast("string")),
        )

    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    reasons = spark.createDataFrame(
        [("A", "Carrier"), ("B", "Weather"), ("C", "NAS"), ("D", "Security")],
        "cancel_code string, cancellation_reason string",
    )
    return Lookups.of(
        codes(suppliers, "C", 15, "Carrier", 14).toDF("carrier_code", "airline_name"),
        codes(parts, "A", 42, "Airport", 7).toDF("airport_code", "origin_airport_name"),
        reasons,
    )


def code_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All six code lists, (Code, Description) each, with the codes the flights have."""
    lists, flights = lookups(spark, sf_dir), source_flights(spark, sf_dir)

    def seen(column: str, labels: dict) -> DataFrame:
        codes = flights.select(column).distinct()
        return codes.select(F.col(column).cast("string"), label(F.col(column), labels)).toDF("Code", "Description")

    flags = flights.select(F.col("cancelled").cast("int").alias("flag")).distinct()
    return {
        "months": seen("month", MONTH_NAMES),
        "weekdays": seen("day_of_week", WEEKDAY_LABELS),
        "carriers": lists.carriers.frame.toDF("Code", "Description"),
        "airports": lists.airports.frame.toDF("Code", "Description"),
        "yes_no": flags.select(
            F.col("flag").cast("string"), F.when(F.col("flag") == 1, "Yes").otherwise("No")
        ).toDF("Code", "Description"),
        "cancellation": lists.cancellation.frame.toDF("Code", "Description"),
    }


def counted_lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    """The code lists with their sizes."""
    return lookups(spark, sf_dir).counted()


def silver_from_text(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The silver rows, parsed from landing text."""
    return build_silver(landing(spark, sf_dir), counted_lookups(spark, sf_dir), **options)


def silver(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    """The silver rows, from the typed flights."""
    return enriched(filled(source_flights(spark, sf_dir, by_month=by_month)), counted_lookups(spark, sf_dir))


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging rows."""
    return staging_view(silver(spark, sf_dir))


def _target(uri: str):
    """File system and path of a folder the tasks write to, made if absent."""
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    filesystem.create_dir(path, recursive=True)
    return filesystem, path


def stored_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared aggregate behind the marts, built from the flights and stored."""
    return stored(flight_base(staging(spark, sf_dir)), "flight-base")


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all grouping sets behind the marts, built from the flights and stored."""
    return stored(mart_cells(staging(spark, sf_dir)), "mart-cells")


def write_landing_files(landing: DataFrame, root: str) -> None:
    """Landing CSV named after its month, one part per month and writing task.

    Best given rows gathered by month, so that a task writes few files. Rows of no
    month belong to no file.
    """
    dated = landing.where(F.col("Year").isNotNull() & F.col("Month").isNotNull())
    lines = _csv_lines(dated, "Year", "Month")
    header_line = (",".join(landing.columns) + "\n").encode()

    def split(batches):
        task = TaskContext.get().partitionId()
        with contextlib.ExitStack() as stack:
            open_files = {}
            for batch in batches:
                month = pc.binary_join_element_wise(batch.column(1), batch.column(2), "_")
                for name in pc.unique(month).to_pylist():
                    if name not in open_files:
                        filesystem, folder = _target(f"{root}/{name.split('_')[0]}")
                        stream = filesystem.open_output_stream(f"{folder}/{name}_{task}.csv")
                        open_files[name] = stack.enter_context(stream)
                        stream.write(header_line)
                    open_files[name].write(_joined(batch.column(0).filter(pc.equal(month, name))))
        yield from ()

    lines.mapInArrow(split, lines.schema).write.format("noop").mode("overwrite").save()


def _csv_lines(landing: DataFrame, *kept: str) -> DataFrame:
    """Every row as a line of CSV, beside the columns kept."""
    plain = {
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    row = F.struct(*[F.col(name) for name in landing.columns])
    return landing.select(F.concat(F.to_csv(row, plain), F.lit("\n")).alias("line"), *kept)


def _joined(lines) -> bytes:
    """The lines of an Arrow array as one text."""
    return "".join(lines.to_pylist()).encode()


def write_archives(landing: DataFrame, folder: str) -> None:
    """Landing rows as ZIP archives with one CSV member, one per writing task."""

    lines = _csv_lines(landing)
    header_line = (",".join(landing.columns) + "\n").encode()

    def pack(batches):
        filesystem, path = _target(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():06d}.zip"
        with (
            filesystem.open_output_stream(name) as stream,
            zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive,
            archive.open("flights.csv", "w", force_zip64=True) as member,
        ):
            member.write(header_line)
            for batch in batches:
                member.write(_joined(batch.column(0)))
        yield from ()

    lines.mapInArrow(pack, lines.schema).write.format("noop").mode("overwrite").save()
