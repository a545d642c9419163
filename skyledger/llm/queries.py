"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import (
    decontaminate,
    language,
    licenses,
    maintext,
    mixing,
    neardup,
    negatives,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    sharding,
)
from skyledger.llm.common import table
from skyledger.llm.oracle import ORACLE  # noqa: F401

#: Ranks of a public byte-level BPE with 50,256 tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by a chosen-path join."""
    like = neardup.Similarity(width=3, percent=85)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), like).drop("key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass external shuffle of all documents into 40 shards."""
    return sharding.shard_table(table(spark, sf_dir, "documents"), shards=40)


def op3_packing(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of all documents in packed rows."""
    tokenizer = packing.Tokenizer(packing.read_ranks(vocabulary))
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights."""
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op5_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return maintext.extract_table(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that copy a benchmark item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of all documents by weak supervision."""
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned through a ledger of blobs."""
    return secrets.scan_table(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.license_table(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by format and by context."""
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, against all."""
    return negatives.hard_negatives(negatives.embedding_rows(table(spark, sf_dir, "embeddings")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs in the words of all documents."""
    return periodic.run_table(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a language model of nine tenths of them."""
    return language.score_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_neardup,
        op2_sharding,
        op3_packing,
        op4_mixing,
        op5_maintext,
        op6_decontaminate,
        op7_quality,
        op8_secrets,
        op9_licenses,
        op10_pii,
        op11_negatives,
        op12_runs,
        op13_language,
    )
}
