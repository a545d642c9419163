"""Landing files: monthly CSV text, or ZIP archives that hold one CSV each."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.parsing import whole_number
from skyledger.schema import LANDING_COLUMNS, landing_schema

# Rows of an archive member held in memory at a time.
ARCHIVE_CHUNK_ROWS = 50_000

# Headers read at the same time.
HEADERS_AT_ONCE = 8

# A month's files: 2023/2023_1.csv, 2023/2023_01.csv, 2023/2023_1_b.csv.
FILE_MONTH = re.compile(r"/(\d{4})/(\d{4})_(\d{1,2})(?:[._][^/]*)?\.csv$")

# Quotes inside a quoted field are doubled; a row that cannot be read fails the job.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_landing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landing CSV files by header, every column as text, reduced to the 28.

    The files hold over a hundred columns, in an order that may differ from
    file to file, so columns are found by name: files with one header are read
    together, groups of files meet by name. Only an empty field is null.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(**CSV_OPTIONS, enforceSchema=False)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda p: tuple(reader.csv(p).columns), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, one in zip(headers, paths, strict=True):
        groups.setdefault(header, []).append(one)
    parts = [
        reader.csv(group).select(*[F.col(f"`{name}`") for name in LANDING_COLUMNS])
        for group in groups.values()
    ]
    return reduce(DataFrame.unionByName, parts)


def is_present(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, asked of Spark's own file listing."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def landing_files(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    ignore: str | None = None,
) -> DataFrame:
    """(path, modified, length, year, month) of the landing files under ``root``.

    With ``years`` only their folders are listed. A CSV file that is not named
    after its month, or lies in another year's folder, is an error, as its rows
    would be left out without a word; ``ignore`` is a pattern of paths to leave
    out on purpose.
    """
    folders = [root] if years is None else [f"{root}/{year}" for year in sorted(set(years))]
    folders = [folder for folder in folders if is_present(spark, folder)]
    empty = spark.createDataFrame([], "path string, modified timestamp, length long, year int, month int")
    if not folders:
        return empty
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(folders)
    )
    if ignore is not None:
        listing = listing.where(~F.col("path").rlike(ignore))

    def part(group: int):
        return F.regexp_extract("path", FILE_MONTH.pattern, group)

    year = F.when((part(1) != "") & (part(1) == part(2)), part(2).cast("int"))
    month = F.when(part(3) != "", part(3).cast("int"))
    named = listing.select(
        "path",
        F.col("modificationTime").alias("modified"),
        "length",
        year.alias("year"),
        F.when(month.between(1, 12), month).alias("month"),
    )
    unnamed = named.where("year is null or month is null").select("path").limit(5).collect()
    if unnamed:
        raise ValueError("not named after a month: " + ", ".join(row.path for row in unnamed))
    return named


def landing_months(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    ignore: str | None = None,
) -> set[tuple[int, int]]:
    """Months that have a landing file, from one listing of the folders."""
    months = landing_files(spark, root, years, ignore).select("year", "month").distinct()
    return {(row.year, row.month) for row in months.collect()}


def read_landing_months(
    spark: SparkSession,
    root: str,
    months: Iterable[tuple[int, int]],
    on_missing: str = "error",
    ignore: str | None = None,
) -> DataFrame:
    """The landing files of the given months, by the very paths that were listed.

    A month without a file is an error, or left out with ``on_missing="skip"``.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError(f"on_missing must be 'error' or 'skip', not {on_missing!r}")
    wanted = set(months)
    listed = landing_files(spark, root, {year for year, _ in wanted}, ignore)
    # Names of the wanted months' files: a few each.
    files = {}
    for row in listed.select("path", "year", "month").collect():
        if (row.year, row.month) in wanted:
            files.setdefault((row.year, row.month), []).append(row.path)
    if on_missing == "error" and set(files) != wanted:
        year, month = min(wanted - set(files))
        raise FileNotFoundError(f"{root}/{year}/{year}_{month}.csv")
    if not files:
        return spark.createDataFrame([], landing_schema())
    paths = sorted(path for of_month in files.values() for path in of_month)
    return only_months(read_landing(spark, paths), files)


def only_months(landing: DataFrame, months: Iterable[tuple[int, int]]) -> DataFrame:
    """The same rows, failing the job on a row of any other month.

    Loads replace the months they meet. A stray row of another month would
    replace all of that month, so it is refused instead of loaded or dropped.
    """
    number = whole_number(F.col("Year")) * 100 + whole_number(F.col("Month"))
    own = number.isin(*[year * 100 + month for year, month in months])
    stray = F.concat_ws(" ", F.lit("row of a month not being loaded:"), "Year", "Month")
    checked = F.when(own, F.col("Year")).otherwise(F.raise_error(stray))
    return landing.withColumn("Year", checked)


def _by_arrow(text: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
    """Rows of a CSV stream, block by block; every column as text, empty as null."""
    names = next(csv.reader([text.readline().decode("utf-8-sig")]), [])
    if any(names.count(name) != 1 for name in LANDING_COLUMNS):
        raise pa.ArrowInvalid("no plain header")
    with pacsv.open_csv(
        text,
        pacsv.ReadOptions(column_names=[f"{k} {name}" for k, name in enumerate(names)], use_threads=False),
        pacsv.ParseOptions(newlines_in_values=True),
        pacsv.ConvertOptions(
            column_types={f"{k} {name}": pa.string() for k, name in enumerate(names)},
            null_values=[""],
            strings_can_be_null=True,
            include_columns=[f"{names.index(name)} {name}" for name in LANDING_COLUMNS],
        ),
    ) as blocks:
        for block in blocks:
            yield block.rename_columns(LANDING_COLUMNS)


def _by_pandas(text: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
    """The same of any CSV, also with short lines, of which the rest is null."""
    chunks = pd.read_csv(
        text,
        dtype=str,
        usecols=LANDING_COLUMNS,
        keep_default_na=False,
        na_values=[""],
        chunksize=ARCHIVE_CHUNK_ROWS,
    )
    kind = pa.schema([(name, pa.string()) for name in LANDING_COLUMNS])
    for chunk in chunks:
        yield pa.RecordBatch.from_pandas(chunk[LANDING_COLUMNS], kind, preserve_index=False)


def _member_rows(archive: zipfile.ZipFile, member: str) -> Iterator[pa.RecordBatch]:
    """Rows of a member; where its lines differ in width, the slower reader goes on."""
    given = 0
    try:
        with archive.open(member) as text:
            for block in _by_arrow(text):
                yield block
                given += block.num_rows
        return
    except (pa.ArrowInvalid, UnicodeDecodeError):
        pass
    with archive.open(member) as text:
        for block in _by_pandas(text):
            known = min(given, block.num_rows)
            given -= known
            yield block.slice(known)


def _first_csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the first CSV member of each archive, block by block."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                member = next((n for n in archive.namelist() if n.endswith(".csv")), None)
                if member is None:
                    raise ValueError(f"no CSV member in {path}")
                yield from _member_rows(archive, member)


def read_archives(spark: SparkSession, path: str, path_filter: str = "*.zip") -> DataFrame:
    """The CSV inside each ZIP archive, as landing rows.

    Spark reads the compressed bytes, from any store it reaches, and packs
    archives into tasks by size; an archive has to fit in one row, 2 GB. Its
    member is streamed from there, so no unpacked month is held in memory. ZIP
    cannot be split: write bronze from this once and read that from then on.
    """
    archives = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", path_filter)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
    return archives.mapInArrow(_first_csv, landing_schema())
