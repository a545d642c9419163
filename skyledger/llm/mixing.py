"""Mixing sources to target weights, exact to the word.

Every document gets a random key: the hash of a seed, its id, its text and the
number of the copy. Rows alike are counted on the map side and numbered from
their count, so neither an id nor a record that a third of the rows hold lands
in one range. Each source is ordered by that key. As the keys are uniform, their leading bits cut a source
into ranges of even size, whatever share of the rows it has; sums over ranges,
then running sums within a range, make the prefix sums, and no task holds more
than a range. A source is taken in whole epochs as long as its budget lasts,
then from the front of its order up to the budget, which the last document
meets in part.

Edge cases: a null source is a source of its own, after all others. A null or
wordless text has size 0 and is taken 0 times. Copies of a row are rows of their
own, but interchangeable. A null id is a key like any other. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import count_words, digest_of, numbered_copies, text_of

#: Weights of the sources in order of name, repeating; the mix as
#: a share of all words; the most epochs of one source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Hexadecimal digits of the key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size and its target in words.

    ``sizes`` has one row per source (source, source_size). The targets are
    ``min(cap, level * weight)`` with the one level that makes them sum to the
    mix: sources reach their cap in order of cap over weight, so the level
    follows from running sums in that order. That is where resharing the excess
    by weight, until none is above its cap, ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place + 1).cast("int"))
    cap = F.col("source_size") * float(EPOCHS)
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("fills_at"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("mix", F.sum("source_size").over(everything) * F.lit(SHARE))
        .withColumn(
            "level",
            (F.col("mix") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
            / F.sum("weight").over(later),
        )
    )
    # The level is the one of the first source that does not reach its cap.
    open_level = F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "level")))
    level = open_level.over(everything)["level"]
    return ranked.withColumn("open_level", level).select(
        "source",
        "source_size",
        F.when(F.col("open_level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("open_level") * F.col("weight")))
        .alias("target"),
    )


def random_key(seed: int) -> Column:
    """Uniform key as text of 32 hexadecimal digits."""
    named = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    parts = F.concat_ws(":", F.lit(str(seed)), named, "digest", F.col("copy").cast("string"))
    return F.md5(parts.cast("binary"))


def records(docs: DataFrame, key: Column, size: Column, source: Column, digest: Column) -> DataFrame:
    """One row per row of ``docs``: key, size, source, digest and number of the copy."""
    narrow = docs.select(
        key.alias("key"), size.alias("size"), source.alias("source"), digest.alias("digest")
    )
    alike = narrow.groupBy("key", "size", "source", "digest").agg(F.count("*").alias("copies"))
    return numbered_copies(alike, "copies", "copy")


def mix(rows: DataFrame, seed: int) -> DataFrame:
    """Every row of ``records`` with source_size, target and taken."""
    rows = rows.withColumn("at", random_key(seed)).withColumn("range", F.substring("at", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    ranges_before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn(
        "range_starts", F.coalesce(F.sum("range_size").over(ranges_before), F.lit(0))
    ).alias("r")
    plan = placed.join(targets(sizes).alias("t"), F.expr("r.source <=> t.source")).select(
        F.col("r.source").alias("source"), "range", "range_starts", "source_size", "target"
    )
    rows_before = (
        Window.partitionBy("source", "range")
        .orderBy("at", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = F.coalesce(F.sum("size").over(rows_before), F.lit(0))
    joined = rows.withColumn("starts", starts).alias("d").join(
        plan.alias("p"), F.expr("d.source <=> p.source and d.range = p.range")
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("range_starts") - F.col("starts")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(
        "key",
        "digest",
        F.col("d.size").alias("size"),
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


def _document_size(text: Column) -> Column:
    return F.coalesce(count_words(text), F.lit(0)).cast("long")


def mix_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix of ``documents`` by number of words."""
    digest = F.md5(text_of(F.col("text")).cast("binary"))
    rows = records(docs, F.col("doc_id"), _document_size(F.col("text")), F.col("source"), digest)
    return mix(rows, seed).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as its words were taken.

    A document taken in part at the end of a budget is given whole, so a source
    exceeds its budget by less than one document. Documents without words add
    nothing to a mix and are left out. What is taken is decided on narrow rows;
    of records alike in all columns one is shuffled, with the number wanted.
    """
    whole = docs.select(F.struct(*docs.columns).alias("record")).withColumn(
        "digest", digest_of(F.col("record"))
    )
    size = _document_size(F.col("record")["text"])
    rows = records(whole, F.col("record")["doc_id"], size, F.col("record")["source"], F.col("digest"))
    wanted = (
        mix(rows, seed)
        .where("taken > 0")
        .groupBy("digest")
        .agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("long").alias("times"))
    )
    given = whole.dropDuplicates(["digest"]).join(wanted, "digest").select("record", "times")
    return numbered_copies(given, "times", "copy").select("record.*")
