"""Hard negatives: near rows of another label, by exact integer inner products.

Anchors are held against all rows, in blocks: a block of anchors, bounded in bytes,
is broadcast and every task scores it tile by tile against the rows it reads. A tile
is a product of two int64 matrices by Strassen's recursion, odd edges padded with
zeros. Its additions are exact, so scores are the true integers.

Two passes. The first keeps a heap of the best rows with the anchor's label, the
positives. The second keeps, for every positive, a heap of the best rows with another
label whose score lies in a window given by the positive's score. Heaps of a task and
tile merge into the same heaps; what tasks leave is merged by a ranked window, so no
group is gathered. Rows are never shuffled, only heaps are.

Edge cases: rows with a null id, label or vector, or a null component, take no part.
Vectors of different lengths are filled up with zeros; an empty one scores 0. Rows
count one by one: a repeated row is a positive or a negative as often as it is there,
and a repeated anchor gives its rows as often. An anchor is not its own positive, a
copy of it is one. Scores tie by smaller id. Without anchors, positives or rows in
the window there are no rows. Scores must stay under 2**50 in size, or it is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import shared_path, stored

#: Bytes of the vectors of a block of anchors, and its rows at most.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 8192
#: Anchors and candidates of a tile.
TILE_ANCHORS, TILE_ROWS = 256, 2048
#: Side of a product that is not split further.
LEAF = 32
#: Scores are less than this, so that a score and a place in a tile fit 63 bits.
SCORE_LIMIT = 1 << 50

_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of int64 matrices by seven products of halves, recursively."""
    m, n, k = len(a), len(b), a.shape[1]
    if min(m, n, k) <= leaf:
        return np.einsum("ik,jk->ij", a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, n % 2), (0, k % 2)))
    h, w, d = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :d], a[:h, d:], a[h:, :d], a[h:, d:]
    # Halves of the right factor, which is given transposed.
    b11, b12, b21, b22 = b[:w, :d], b[w:, :d], b[:w, d:], b[w:, d:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of some rows, the best ``size`` of (score, id): high scores, then low ids."""

    def __init__(self, shape: tuple[int, ...], size: int):
        self.size = size
        self.scores = np.full((*shape, size), _NONE)
        self.ids = np.zeros((*shape, size), np.int64)

    def merge(self, at, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in further entries of the rows ``at``; ``_NONE`` is no entry."""
        scores = np.concatenate([self.scores[at], scores], axis=-1)
        ids = np.concatenate([self.ids[at], ids], axis=-1)
        # Complement turns the order round without overflow.
        order = np.lexsort((ids, ~scores), axis=-1)[..., : self.size]
        self.scores[at] = np.take_along_axis(scores, order, -1)
        self.ids[at] = np.take_along_axis(ids, order, -1)


def best_of_tile(keys: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best keys of every row of a tile.

    A key is ``score * n`` plus the place of the candidate counted from the last id, so
    larger keys are higher scores, then smaller ids.
    """
    n = len(ids)
    if n > size:
        keys = np.partition(keys, n - size, axis=1)[:, n - size :]
    there = keys != _NONE
    scores, place = np.divmod(keys, n)
    return np.where(there, scores, _NONE), np.where(there, ids[n - 1 - place], 0)


class Anchors:
    """A block of anchors: numbers, labels and vectors, and the scores of their positives."""

    def __init__(self, numbers, labels, vectors, positives=None):
        self.numbers, self.labels, self.vectors = numbers, labels, vectors
        self.positives = positives

    def tiles(self) -> Iterator[slice]:
        for start in range(0, len(self.numbers), TILE_ANCHORS):
            yield slice(start, min(start + TILE_ANCHORS, len(self.numbers)))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _scored(
    batches: Iterator[pa.RecordBatch], anchors: Anchors, width: int
) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles: which anchors, ids by size, scores, and where the labels are equal."""
    codes = {label: k for k, label in enumerate(dict.fromkeys(anchors.labels))}
    own = np.array([codes[label] for label in anchors.labels])
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            ids = part.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _matrix(part.column("vector"), width)[order]
            labels = np.array([codes.get(x, -1) for x in part.column("label").to_pylist()])[order]
            for at in anchors.tiles():
                yield at, ids, strassen(anchors.vectors[at], vectors), own[at, None] == labels


def _flat(numbers: np.ndarray, heaps: Heaps, names: list[str]) -> pa.RecordBatch:
    """The entries of heaps, one a row: number, places along the other axes, score, id."""
    where = np.nonzero(heaps.scores != _NONE)
    columns = [pa.array(numbers[where[0]])]
    columns += [pa.array(axis.astype(np.int32) + 1) for axis in where[1:-1]]
    columns += [pa.array(heaps.scores[where]), pa.array(heaps.ids[where])]
    return pa.RecordBatch.from_arrays(columns, names)


def _best_equal(anchors: Anchors, width: int, size: int) -> Callable:
    """Best rows of the anchor's label, the anchor itself among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps((len(anchors.numbers),), size)
        for at, ids, scores, equal in _scored(batches, anchors, width):
            keys = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)
            heaps.merge(at, *best_of_tile(np.where(equal, keys, _NONE), ids, size))
        yield _flat(anchors.numbers, heaps, ["number", "score", "id"])

    return run


def _best_different(anchors: Anchors, width: int, size: int, low: int, high: int) -> Callable:
    """Best rows of other labels in the window of each positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals = anchors.positives
        heaps = Heaps(goals.shape, size)
        # low * p <= 100 * s <= high * p, with whole bounds of s; no positive, empty window.
        floor = np.where(goals == _NONE, 0, -(-low * np.where(goals == _NONE, 0, goals) // 100))
        ceiling = np.where(goals == _NONE, -1, high * np.where(goals == _NONE, 0, goals) // 100)
        for at, ids, scores, equal in _scored(batches, anchors, width):
            keys = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)
            keys[equal] = _NONE
            for k in range(goals.shape[1]):
                fits = (scores >= floor[at, k, None]) & (scores <= ceiling[at, k, None])
                if fits.any():
                    heaps.merge((at, k), *best_of_tile(np.where(fits, keys, _NONE), ids, size))
        yield _flat(anchors.numbers, heaps, ["number", "place", "score", "id"])

    return run


def _ranked(entries: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best ``size`` entries of each key, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _numbered(rows: DataFrame, width: int) -> DataFrame:
    """Anchors, equal ones once, with a number, their block and how many they are."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    once = rows.where("anchor").groupBy("id", "label", "vector").agg(F.count("*").alias("copies"))
    once = stored(once, "anchors")
    spread = once.repartition(max(1, -(-once.count() // size)))
    numbered = stored(spread.withColumn("number", F.monotonically_increasing_id()), "anchors")
    # The upper bits are the partition: a block is a stretch of one, of bounded size.
    within = F.col("number").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("block", F.shiftright("number", 33) * (1 << 33) + within - within % size)


def _load(block: DataFrame, width: int, places: int) -> Anchors:
    """One block, in the order of its numbers; bounded by its definition."""
    held = block.orderBy("number").toArrow()
    goals = np.full((held.num_rows, places), _NONE)
    for k, scores in enumerate(held["goals"].to_pylist() if places else []):
        goals[k, : len(scores or [])] = scores or []
    vectors = _matrix(held["vector"].cast(pa.list_(pa.int64())), width)
    return Anchors(held["number"].to_numpy(), held["label"].to_pylist(), vectors, goals)


def hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Triples of anchor, positive and hard negative.

    ``rows`` has ``id`` long, ``label``, ``vector`` array of long and ``anchor`` boolean.
    A negative's score is ``low`` to ``high`` percent of the positive's. Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rank
    counts the negatives of an anchor and positive from 1.
    """
    if high > 100 or low > high:
        raise ValueError("a window is low to high, of 100 percent at most")
    rows = rows.select(
        F.col("id").cast("long"), F.col("label").cast("string"),
        F.col("vector").cast("array<bigint>"), F.coalesce("anchor", F.lit(False)).alias("anchor"),
    ).dropna(subset=["id", "label", "vector"]).where(F.forall("vector", F.isnotnull))
    spark = rows.sparkSession
    extent = rows.agg(
        F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("top"),
    ).first()
    width = extent.width or 0
    if width * int(extent.top or 0) ** 2 >= SCORE_LIMIT:
        raise ValueError(f"{width} components up to {extent.top} make scores beyond {SCORE_LIMIT}")
    anchors = _numbered(rows, width)
    blocks = [r.block for r in anchors.select("block").distinct().orderBy("block").collect()]
    given = rows.select("id", "label", "vector")

    def passed(work: Callable, source: DataFrame, places: int, kind: str, name: str) -> DataFrame:
        """The heaps of all tasks, block by block, in a table."""
        path = shared_path(spark, name)
        spark.createDataFrame([], kind).write.parquet(path)
        for block in blocks:
            held = _load(source.where(F.col("block") == block), width, places)
            given.mapInArrow(work(held), kind).write.mode("append").parquet(path)
        return spark.read.schema(kind).parquet(path)

    # One place more than asked for, as the anchor finds itself, too.
    first = passed(
        lambda held: _best_equal(held, width, positives + 1), anchors, 0,
        "number long, score long, id long", "positives",
    )
    own = F.aggregate(
        F.col("vector"), F.lit(0).cast("long"), lambda total, x: total + x * x
    )
    who = anchors.select("number", F.col("id").alias("anchor_id"), own.alias("own"))
    ranked = _ranked(first, ["number"], positives + 1).join(who, "number")
    itself = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    of_anchor = Window.partitionBy("number")
    others = ranked.withColumn("self", F.min(F.when(itself, F.col("rank"))).over(of_anchor)).select(
        "number",
        (F.col("rank") - F.coalesce(F.col("self") < F.col("rank"), F.lit(False)).cast("int")).alias("place"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.coalesce(F.col("self") == F.col("rank"), F.lit(False)).alias("is_self"),
    )
    chosen = stored(others.where(~F.col("is_self") & (F.col("place") <= positives)).drop("is_self"), "positives")

    goals = chosen.groupBy("number").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]
        ).alias("goals")
    )
    second = passed(
        lambda held: _best_different(held, width, negatives, low, high),
        anchors.join(goals, "number", "left"), positives,
        "number long, place int, score long, id long", "negatives",
    )
    found = _ranked(second, ["number", "place"], negatives)
    repeated = anchors.select("number", F.col("id").alias("anchor_id"), "copies")
    triples = found.join(chosen, ["number", "place"]).join(repeated, "number")
    return triples.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def embedding_rows(
    embeddings: DataFrame, scale: int = 256, relabel_every: int = 7, classes: int = 10, anchor_every: int = 100
) -> DataFrame:
    """Rows of a table vec_id, embedding, label as ``hard_negatives`` takes them.

    Components become whole numbers, ``floor(scale * x)``. Every seventh id gets the
    next label, as noise. Rows with a null or non-finite component are left out.
    """
    x_of = F.col("embedding").cast("array<double>")
    finite = F.forall(x_of, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    label, number = F.col("label"), F.col("vec_id")
    noisy = F.when(number % relabel_every == 0, (label + 1) % classes).otherwise(label)
    return embeddings.where(label.isNotNull() & finite).select(
        number.alias("id"),
        noisy.alias("label"),
        F.transform(x_of, lambda x: F.floor(x * scale)).alias("vector"),
        (number % anchor_every == 0).alias("anchor"),
    )
