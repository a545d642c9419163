"""Shards for training: a two-pass external shuffle on DataFrame functions.

First pass: seeded hashes scatter the records uniformly, over the shards and
within each shard over buckets that fit in memory. Second pass: every bucket is
put in random order by a Fisher-Yates shuffle (what Spark's ``shuffle`` does)
and written. A shard is the sequence of its buckets, so only one bucket is ever
held in memory, however large the shard: a shard has as many buckets as its own
bytes need, and a record's bucket follows from all its columns and the number of
the copy, so one key or one record on a third of all rows is spread as well.

The shard follows from the key and the number of shards alone: each shard draws
a hash for the key and the highest wins. With one more shard a key moves only if
the new shard's hash is the highest, so rows move to the new shard and nowhere
else.

Edge cases: an empty table gives no rows. A null key is a key like any other:
such rows share a shard but not a bucket.
Repeated rows stay separate rows with slots of their own. A null text has no
bytes and the checksum of no bytes. Written records keep the columns of the
input but those named like an added column (shard, bucket, slot), which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import digest_of, numbered_copies, text_of, without

#: Bytes that one task shuffles at a time.
BUCKET_BYTES = 64 << 20
#: Besides the text, bytes that a record takes by the law of sizes, and in memory.
RECORD_BYTES, MEMORY_BYTES = 16, 128
#: Tasks of the second pass; more buckets than that share tasks, one at a time.
MOST_TASKS = 10_000
ADDED = ("shard", "bucket", "slot")


def record_bytes(text: Column) -> Column:
    """Size of a record: UTF-8 bytes of its text and a fixed part."""
    return (F.octet_length(text_of(text)) + RECORD_BYTES).cast("long")


def _draw(key: Column, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(f"shard {seed}"), shard.cast("int"), key)


def shard_of(key: Column, shards: int, seed: int) -> tuple[Column, Column]:
    """The key's shard among ``shards``, and among one more."""
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(_draw(key, s, seed).alias("draw"), s.alias("shard")),
    )
    best = F.array_max(ranked)
    added = F.struct(_draw(key, F.lit(shards), seed).alias("draw"), F.lit(shards).alias("shard"))
    return best["shard"], F.greatest(best, added)["shard"]


def buckets_of(placed: DataFrame, shards: int) -> list[int]:
    """How many buckets each shard needs for one to fit in memory."""
    held = placed.groupBy("shard").agg(F.sum(F.col("size") + MEMORY_BYTES).alias("bytes"))
    needed = {r["shard"]: -(-r["bytes"] // BUCKET_BYTES) for r in held.collect()}  # a row a shard
    return [needed.get(s, 1) for s in range(shards)]


def external_shuffle(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """All rows with shard, grown_shard, bucket, and slot: the place in the shard.

    ``rows`` are narrow and all different: key, size and what else tells them
    apart. Slots count from 0 without gaps. The order is the same in every run:
    each bucket is sorted before it is shuffled, and each task goes through its
    buckets in order.
    """
    carried = rows.columns
    shard, grown = shard_of(F.col("key"), shards, seed)
    placed = rows.withColumns({"shard": shard, "grown_shard": grown})
    buckets = buckets_of(placed, shards)
    place = F.xxhash64(F.lit(f"bucket {seed}"), *carried)
    many = F.element_at(F.array(*[F.lit(n) for n in buckets]), F.col("shard") + 1)
    scattered = placed.withColumn("bucket", F.pmod(place, many.cast("long")))
    bucket = ["shard", "bucket"]
    counts = scattered.groupBy(*bucket).count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot")
    )
    gathered = (
        scattered.repartition(min(MOST_TASKS, sum(buckets)), *bucket)
        .groupBy(*bucket)
        .agg(F.array_sort(F.collect_list(F.struct(*carried, "grown_shard"))).alias("records"))
        .sortWithinPartitions(*bucket)
    )
    shuffled = gathered.select(*bucket, F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    return shuffled.join(first, bucket).select(
        "record.*", *bucket, (F.col("first_slot") + F.col("at")).cast("long").alias("slot")
    )


def _numbered(narrow: DataFrame) -> DataFrame:
    """Rows alike counted on the map side, then numbered."""
    alike = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies"))
    return numbered_copies(alike, "copies", "copy")


def shard_table(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Where every record of ``documents`` goes, with its size and checksum."""
    narrow = docs.select(
        F.col("doc_id").alias("key"),
        record_bytes(F.col("text")).alias("size"),
        F.crc32(text_of(F.col("text")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return external_shuffle(_numbered(narrow), shards, seed).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Writes whole records, ``shard=N`` folders with rows in slot order.

    A file holds whole buckets; sorting a shard's rows by slot restores its
    order over all files. Places are found on narrow rows and of records alike
    in all columns one is shuffled to them.
    """
    docs = without(docs, *ADDED)
    whole = docs.select(F.struct(*docs.columns).alias("record")).withColumn(
        "digest", digest_of(F.col("record"))
    )
    narrow = whole.select(
        F.col("record")["doc_id"].alias("key"),
        record_bytes(F.col("record")["text"]).alias("size"),
        "digest",
    )
    places = external_shuffle(_numbered(narrow), shards, seed).select("digest", "shard", "bucket", "slot")
    placed = whole.dropDuplicates(["digest"]).join(places, "digest")
    (
        placed.repartition("shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "slot")
        .select("record.*", "bucket", "slot", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
