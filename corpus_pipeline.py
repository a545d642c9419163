"""From raw documents to a sharded training mix, in five stages.

Each stage works on all rows the one before it kept and is written to the shared
folder before the next begins, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import decontaminate, mixing, neardup, quality, sharding
from skyledger.llm.common import stored, table

#: Near duplicates: sets of five-word shingles, linked from 80 percent.
LIKE = neardup.Similarity(width=5, percent=80)
SHARDS = 40

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return quality.good_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.one_of_each(docs, LIKE)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from every source as much as the mix gives it, repeating documents."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.shard_table(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

# The label model and the alignment have no equivalent in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
