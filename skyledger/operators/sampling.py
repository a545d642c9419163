"""Repeatable samples of exactly n rows.

``with_draw`` and ``lowest_draws`` sample rows as they are stored: the draw of a row is
a digest of its file and its place in it, so every row has its own and nothing has to
be counted; the n lowest meet in one small exchange. ``sample_rows`` samples any rows,
which have no place, by their values and the number of the copy; it counts copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.sources.tables import stored

# Copies of one row expanded by one task at most.
COPIES_PER_TASK_ROW = 100_000


def draw_of(columns: list[str], seed: int) -> Column:
    """The draw of a row: a digest of its values, its copy number and the seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in [*columns, "copy"]]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def with_draw(scan: DataFrame, seed: int = 42, file: Column | None = None) -> DataFrame:
    """Rows read from Parquet files with their ``draw``.

    ``scan`` must be the reader's own frame, whose rows know where they lie. ``file``
    names a file, by default its whole path, so a table that moved draws anew.
    """
    place = F.col("_metadata.file_path") if file is None else file
    parts = [place, F.col("_metadata.row_index").cast("string"), F.lit(str(seed))]
    return scan.withColumn("draw", F.md5(F.concat_ws("|", *parts).cast("binary")))


def lowest_draws(df: DataFrame, columns: list[str], n: int, keep_nulls: bool = False) -> DataFrame:
    """``n`` rows without replacement, those with the lowest draws.

    Rows with a null in a column are left out unless ``keep_nulls`` is set. Every task
    keeps its ``n`` lowest and only those are exchanged.
    """
    chosen = df.select(*columns, "draw")
    known = chosen if keep_nulls else chosen.dropna(subset=columns)
    return known.orderBy("draw").limit(n).select(*columns)


def sample_rows(
    df: DataFrame, columns: list[str], n: int, seed: int = 42, keep_nulls: bool = False
) -> DataFrame:
    """``n`` rows without replacement.

    Rows with a null in a column are left out unless ``keep_nulls`` is set. The
    lowest draws win. The outcome is the same however the rows are partitioned
    and however often a task is run again.

    Copies of a row are counted before they are shuffled, and numbered in
    slices, so no task holds all copies of one row. Rows of one slice are drawn
    where their counts were stored; only the slices of others are dealt out. The
    counts are stored, as they are read several times. Draws above a cut that leaves slightly more
    than ``n`` are dropped before the final sort; should the cut leave too
    few, it is lifted.
    """
    chosen = df.select(*columns) if keep_nulls else df.select(*columns).dropna()
    counted = stored(chosen.groupBy(*columns).agg(F.count("*").alias("copies")), "sample")
    last_slice = F.floor((F.col("copies") - 1) / COPIES_PER_TASK_ROW).cast("bigint")
    few = F.col("copies") <= COPIES_PER_TASK_ROW
    slices = counted.where(~few).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), last_slice)))
    dealt = slices.repartition(*columns, "slice")
    spread = counted.where(few).withColumn("slice", F.lit(0).cast("bigint")).unionByName(dealt)
    first = F.col("slice") * COPIES_PER_TASK_ROW
    until = F.least(first + COPIES_PER_TASK_ROW, F.col("copies")) - 1
    rows = spread.withColumn("copy", F.explode(F.sequence(first, until)))
    drawn = rows.select(*columns, "copy", draw_of(columns, seed).alias("draw"))

    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    share = (n + 10 * math.sqrt(n) + 50) / max(total, 1)
    if share < 1:
        below = drawn.where(F.col("draw") < f"{int(share * 16**8):08x}")
        if below.count() >= n:
            drawn = below
    return drawn.orderBy("draw", "copy").limit(n).select(*columns)
