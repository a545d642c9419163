"""What the operators of this package share: text expressions and folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space is blank, tab, line feed, vertical tab, form feed
# and carriage return; everything else belongs to a word.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Inside a lambda Spark evaluates an outer expression for every element;
    binding it as the only element of an array evaluates it once a row.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(column: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words of a text, null for null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any spelling of case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only a session on one machine that names no folder gets one of its own,
    which then stays the session's.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Several jobs read them then without computing them again, also after an
    executor was lost.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Copies that one step of ``numbered_copies`` makes of a row.
COPY_BLOCK = 10_000


def numbered_copies(counted: DataFrame, count: str, name: str) -> DataFrame:
    """Every row as often as ``count`` says, its copies numbered from 1 in ``name``.

    Rows that are alike can so be counted before they are shuffled and still be
    placed one by one. Copies are made in blocks, so none of any number is held.
    """
    kept = [c for c in counted.columns if c != count]
    last = F.floor((F.col(count) - 1) / F.lit(COPY_BLOCK)).cast("long")
    blocks = counted.where(F.col(count) > 0).select(
        *kept, count, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_block")
    )
    before = F.col("_block") * F.lit(COPY_BLOCK)
    copies = F.sequence(before + 1, F.least(F.col(count), before + COPY_BLOCK))
    return blocks.select(*kept, F.explode(copies).alias(name))


def digest_of(record: Column) -> Column:
    """Digest of a whole record, its columns in order with their names."""
    return F.sha2(F.to_json(record), 256)
