"""Monthly parquet tables: a directory per month, replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.parsing import whole_number
from skyledger.schema import (
    CLUSTER_KEYS,
    LANDING_COLUMNS,
    MONTH_KEYS,
    SILVER_COLUMNS,
    staging_type,
)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, in the folder the cluster shares.

    Executors have to reach it, so a machine-local folder is only used where
    the session runs on one machine and names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="skyledger-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder once and read from there.

    For intermediate results that several jobs read: nothing upstream is
    computed again, also not after an executor is lost.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear(spark: SparkSession, path: str, folders: Iterable[str]) -> None:
    """Remove partition folders of a table, those that exist."""
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a month brought together, a month too big for one task split.

    Best done while rows are narrow: columns made from them later, row by row, need no
    shuffle, and a writer given the wide rows then needs no ``gather``.
    """
    return df.hint("rebalance", *keys)


def replace_months(
    df: DataFrame,
    path: str,
    gather: bool = False,
    months: Iterable[tuple[int, int]] | None = None,
    keys: Sequence[str] = MONTH_KEYS,
) -> None:
    """Write months, replacing exactly the months present in ``df``.

    Running it again leaves one copy. ``df`` has to hold whole months. With
    ``months``, the months being sent, those without a row in ``df`` are
    emptied: a month sent again without rows has none.

    Rows read from monthly files stay in the tasks that read them: nothing is
    shuffled, and a month holding most of the rows is written by as many tasks
    as read it. Rows in no such order would make every task write to every
    month; ``gather`` then brings a month's rows together first. Its rebalance
    hint lets adaptive execution split a month too big for one task, which a
    plain repartition by the same keys would not.
    """
    arranged = gathered(df, *keys) if gather else df
    seen = Observation()
    if months is not None:
        arranged = arranged.observe(seen, F.collect_set(F.struct(*keys)).alias("months"))
    (
        arranged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    if months is not None:
        written = {tuple(month) for month in seen.get["months"]}
        year, month = keys
        gone = sorted(set(months) - written)
        _clear(df.sparkSession, path, [f"{year}={y}/{month}={m}" for y, m in gone])


def append_months(df: DataFrame, path: str) -> None:
    """Add rows to their months without removing any; reruns duplicate them."""
    df.write.mode("append").partitionBy(*MONTH_KEYS).parquet(path)


def write_clustered(
    df: DataFrame,
    path: str,
    partition: list[str] = MONTH_KEYS,
    cluster: list[str] = CLUSTER_KEYS,
    append: bool = False,
) -> None:
    """Partitioned table whose files hold narrow ranges of the cluster keys.

    Rows are ranged over the tasks by partition and cluster keys together: a
    partition too big for one task becomes several files whose ranges do not
    overlap, and several small ones share a task. Look-ups by the cluster keys
    then skip whole files, and row groups of the rest.
    """
    arranged = df.repartitionByRange(*partition, *cluster).sortWithinPartitions(*partition, *cluster)
    writer = arranged.write.partitionBy(*partition)
    if append:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


#: Rows whose keys set the bounds of an interleaved layout, and bits of each key.
#: The sample shapes files only; what is stored and found does not depend on it.
LAYOUT_ROWS, LAYOUT_BITS = 10_000, 6


def _buckets(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Each key's place among the quantiles of a sample: 0 to 2 ** LAYOUT_BITS - 1."""
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys, F.monotonically_increasing_id())).limit(LAYOUT_ROWS)
    rows = drawn.collect()

    def tree(value: Column, bounds: list, low: int, high: int) -> Column:
        """Number of bounds up to the value, by halving: few comparisons a row."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), tree(value, bounds, low, middle)).otherwise(
            tree(value, bounds, middle + 1, high)
        )

    places = []
    for key in keys:
        known = sorted(r[key] for r in rows if r[key] is not None)
        at = [k * len(known) >> LAYOUT_BITS for k in range(1, 1 << LAYOUT_BITS)] if known else []
        bounds = sorted({known[k] for k in at})
        places.append(F.when(F.col(key).isNull(), F.lit(0)).otherwise(tree(F.col(key), bounds, 0, len(bounds))))
    return places


def interleaved(places: Sequence[Column]) -> Column:
    """One number of the bits of all places in turn, the highest first."""
    total = F.lit(0)
    for bit in range(LAYOUT_BITS):
        for k, place in enumerate(places):
            taken = F.shiftright(place, bit).bitwiseAND(1)
            total = total + F.shiftleft(taken, bit * len(places) + len(places) - 1 - k)
    return total


def write_interleaved(
    df: DataFrame,
    path: str,
    partition: Sequence[str] = MONTH_KEYS,
    keys: Sequence[str] = CLUSTER_KEYS,
    files: int | None = None,
) -> None:
    """Partitioned table whose files hold narrow ranges of every key at once.

    A table ranged by one key after the other keeps only the first key together. Here
    the bits of the keys' quantiles alternate, so a file is a small box in all of them
    and a look-up by any one key alone skips most files, too. Bloom filters let it skip
    row groups whose range holds the key but whose rows do not. ``files`` is the number
    of ranges the whole table is cut into.
    """
    place = interleaved(_buckets(df, keys))
    placed = df.withColumn("layout", place)
    by = [*partition, "layout", *keys]
    ranged = placed.repartitionByRange(files, *by) if files else placed.repartitionByRange(*by)
    writer = ranged.sortWithinPartitions(*by).drop("layout").write.partitionBy(*partition)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_mart(df: DataFrame, path: str) -> None:
    """Replace a mart as a whole."""
    df.write.mode("overwrite").parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    """Write a monthly table anew; months it held before are gone."""
    (
        gathered(df, *MONTH_KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*MONTH_KEYS)
        .parquet(path)
    )


def to_bronze(
    landing: DataFrame,
    path: str,
    gather: bool = False,
    months: Iterable[tuple[int, int]] | None = None,
) -> None:
    """Landing text as parquet under ``year=/month=``, months replaced.

    Year and Month live in the path alone: two spellings of one name in path
    and file would be one column to Spark. A row whose year or month cannot be
    read fails the job; it belongs to no month and would be lost.
    """
    year, month = whole_number(F.col("Year")), whole_number(F.col("Month"))
    unreadable = F.concat_ws(
        " ", F.lit("row of no month:"), F.coalesce("Year", F.lit("-")), F.coalesce("Month", F.lit("-"))
    )
    keyed = landing.select(
        *[F.col(c) for c in LANDING_COLUMNS if c not in ("Year", "Month")],
        F.when(year.isNotNull() & month.isNotNull(), year)
        .otherwise(F.raise_error(unreadable))
        .alias("year"),
        month.alias("month"),
    )
    replace_months(keyed, path, gather, months)


def as_landing(df: DataFrame) -> DataFrame:
    """The 28 columns as landing text, whatever type a file stores them in."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in LANDING_COLUMNS])


def in_month(df: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of one month; prunes to its directory on a monthly table."""
    return df.where((F.col("year") == year) & (F.col("month") == month))


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """All months of bronze, as landing text."""
    return as_landing(spark.read.parquet(path))


def read_bronze_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """One month of bronze, as landing text. Other months are not listed as input."""
    return as_landing(in_month(spark.read.parquet(path), year, month))


def read_drifting_bronze(
    spark: SparkSession, path: str, months: Iterable[tuple[int, int]]
) -> DataFrame:
    """Bronze whose column types were inferred per month, as landing text.

    Such files store one column as number in one month and as text in the
    next. Each month is read under its own schema and turned to text before
    the months meet.
    """
    parts = [
        as_landing(
            spark.read.option("basePath", path).parquet(f"{path}/year={year}/month={month}")
        )
        for year, month in months
    ]
    return reduce(DataFrame.unionByName, parts)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """The silver table in its column order, months pruned by later filters."""
    return spark.read.parquet(path).select(*SILVER_COLUMNS)


def stored_months(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """Months a monthly table holds: a few hundred pairs.

    Taken from the listing; no parquet file is opened for it.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return set()
        raise
    if not set(MONTH_KEYS) <= set(files.columns):
        return set()
    rows = files.select(*MONTH_KEYS).distinct().collect()
    if any(row.year is None or row.month is None for row in rows):
        raise ValueError(f"{path} holds rows of no month")
    return {(row.year, row.month) for row in rows}


# Typed copies of Year and Month that the text tables are partitioned by.
TEXT_KEYS = ("load_year", "load_month")


def replace_text_months(
    df: DataFrame,
    path: str,
    gather: bool = False,
    months: Iterable[tuple[int, int]] | None = None,
) -> None:
    """Like :func:`replace_months`, for tables that keep Year and Month as text.

    The text stays in the files as it came; the folders carry numbers.
    """
    keyed = df.withColumns(
        {key: whole_number(F.col(text)) for key, text in zip(TEXT_KEYS, ("Year", "Month"), strict=True)}
    )
    replace_months(keyed, path, gather, months, TEXT_KEYS)


def load_raw_text(
    landing: DataFrame,
    path: str,
    gather: bool = False,
    months: Iterable[tuple[int, int]] | None = None,
) -> None:
    """Text table of all 28 columns, created when absent, months replaced."""
    replace_text_months(landing.select(*LANDING_COLUMNS), path, gather, months)


def read_raw_text(
    spark: SparkSession, path: str, year: int | None = None, month: int | None = None
) -> DataFrame:
    """The text table, or the month whose Year and Month text match.

    The numbers in the folders keep other months from being read.
    """
    raw = spark.read.parquet(path)
    for text, key, value in zip(("Year", "Month"), TEXT_KEYS, (year, month), strict=True):
        if value is not None:
            raw = raw.where((F.col(key) == value) & (F.col(text) == str(value)))
    return as_landing(raw)


def read_text_staging(spark: SparkSession, path: str) -> DataFrame:
    """The text path's staging rows; Year and Month are text there, too."""
    return spark.read.parquet(path).select(
        *[F.col(c).cast(staging_type(c)).alias(c) for c in LANDING_COLUMNS], "delay_category"
    )
