"""Periodic runs in the words of a text, by uniting suffix classes in order of LCP.

A run is a stretch of words with smallest period q, as long as ``least_power`` periods
and ``least_length`` words at least, that no neighbouring word extends. Two places
whose texts agree for l words belong to one class at level l. Classes are united by
decreasing length of the longest common prefix (LCP) of neighbours in suffix order, as
Kruskal's algorithm takes edges; union-find holds their places in order. Where two
places i < j become neighbours in a united class at level l and j - i is within l,
the words from i to j + l - 1 have the period j - i: a seed. It is a smallest period,
as a smaller one would put a place of the same class between, and nothing extends it
to the right, as l is the whole common prefix. The one seed of a run that nothing
extends to the left either gives the run; the others lie inside.

Suffix order comes from prefix doubling over groups of whole texts at once, in numpy.
A text is worked on whole, in one task, with some 100 bytes a word in memory and 4 for
each doubling of its longest repeat; nothing is shuffled.

Exact savings: levels too low for any seed are not united, nor classes whose nearest
places are further apart than any of their common prefixes allows.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed
text. Rows are worked on one by one, so repeated rows give repeated results and null
ids stay. Columns called ``runs`` or ``collapsed`` give way to the new ones.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import let, text_of, without, words

#: Least length of a run in words, and in periods.
LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words of the texts that are worked on at once; a longer text is worked on alone.
GROUP_WORDS = 1 << 19

Run = tuple[int, int, int]

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


class _Numbers(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key) -> int:
        value = self[key] = len(self)
        return value


def least_level(least_length: int, least_power: int) -> int:
    """Least common prefix of the two places that seed a run."""
    return min(max(least_length - q, (least_power - 1) * q) for q in range(1, least_length + 1))


def _groups_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs, and where in that order a new pair begins."""
    order = np.lexsort((second, first))
    begins = np.ones(len(order), bool)
    a, b = first[order], second[order]
    begins[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, begins


def suffix_classes(ids: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order with the LCP to the place before, as far as it is ``level``.

    ``ids`` are words and ``text`` the text of each; every text ends in a word of its
    own. Only places that share ``level`` words with another of their text are
    returned; an LCP below ``level`` is 0, also at the first place.
    """
    n = len(ids)
    order, begins = _groups_of(text, ids)
    rank = np.empty(n, np.int32)
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank[order] = start
    alone = begins & np.append(begins[1:], True)
    active = order[~alone]  # in rank order throughout
    kept, ranks, width = active, [rank.copy()], 1
    while len(active):
        if width <= level:
            kept = active
        # Only within groups of equal ranks, which stay where they are.
        order, begins = _groups_of(rank[active], rank[active + width])
        active = active[order]
        own = rank[active]
        new = np.arange(len(active)) - np.searchsorted(own, own)  # place within the old group
        new = own + new[np.maximum.accumulate(np.where(begins, np.arange(len(active)), 0))]
        rank[active] = new
        alone = begins & np.append(begins[1:], True)
        active = active[~alone]
        width *= 2
        ranks.append(rank.copy())
    places = kept[np.argsort(rank[kept])]
    low, high = places[:-1], places[1:]
    lcp = np.zeros(len(low), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        # Places whose prefix reaches the end of a text differ there.
        same = ranks[k][np.minimum(low + lcp, n - 1)] == ranks[k][np.minimum(high + lcp, n - 1)]
        lcp += np.where(same, 1 << k, 0)
    lcp = np.where(lcp >= level, lcp, 0)
    return places, np.concatenate([np.zeros(min(1, len(places)), np.int64), lcp])


def _hopeful(places: np.ndarray, lcp: np.ndarray, power: int) -> np.ndarray:
    """Numbers of the classes some of whose places are near enough to seed a run."""
    cls = np.cumsum(lcp == 0) - 1
    order = np.lexsort((places, cls))
    gap = np.diff(places[order])
    gap[np.diff(cls[order]) != 0] = np.iinfo(np.int64).max
    firsts = np.flatnonzero(lcp == 0)
    nearest = np.minimum.reduceat(np.append(gap, np.iinfo(np.int64).max), firsts)
    highest = np.maximum.reduceat(lcp, firsts)
    return np.flatnonzero(nearest <= highest // (power - 1))


def united(places: list[int], lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Pairs of places as they become neighbours in a class, with the level.

    ``places`` are in suffix order, ``lcp[k]`` between the ones at k - 1 and k.
    """
    root = list(range(len(places)))
    members = [[p] for p in places]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in sorted(range(1, len(places)), key=lambda k: -lcp[k]):
        level = lcp[k]
        if not level:
            return
        small, large = find(k - 1), find(k)
        if len(members[small]) > len(members[large]):
            small, large = large, small
        root[small] = large
        held, coming = members[large], members[small]
        members[small] = []
        for p in coming:
            insort(held, p)
        came = set(coming)
        for p in coming:
            at = bisect_left(held, p)
            if at and held[at - 1] not in came:
                yield held[at - 1], p, level
            if at + 1 < len(held) and held[at + 1] not in came:
                yield p, held[at + 1], level


def runs_of(texts: list[list[bytes]], least_length: int, least_power: int) -> list[list[Run]]:
    """The runs of each of some texts, given as words, by start and period."""
    sizes = [len(t) for t in texts]
    numbers = _Numbers()
    ids = np.empty(sum(sizes) + len(texts) + 1, np.int64)
    ids[0], at = -1, 1
    starts = []
    for k, (held, size) in enumerate(zip(texts, sizes)):
        starts.append(at)
        ids[at : at + size] = [numbers[w] for w in held]
        ids[at + size] = -2 - k  # an end of its own
        at += size + 1
    text = np.repeat(np.arange(-1, len(texts)), [1, *(s + 1 for s in sizes)])
    places, lcp = suffix_classes(ids, text, least_level(least_length, least_power))
    found: list[list[Run]] = [[] for _ in texts]
    if not len(places):
        return found
    firsts = np.append(np.flatnonzero(lcp == 0), len(places))
    for c in _hopeful(places, lcp, least_power):
        part = slice(firsts[c], firsts[c + 1])
        k = int(text[places[firsts[c]]])
        for i, j, level in united(places[part].tolist(), lcp[part].tolist()):
            q = j - i
            long_enough = level >= (least_power - 1) * q and level + q >= least_length
            if long_enough and ids[i - 1] != ids[j - 1]:
                found[k].append((i - starts[k], level + q, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(held: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return held
    keep = np.ones(len(held), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [held[k] for k in np.flatnonzero(keep)]


def periodic_runs(
    docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER
) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period by start, then period) and ``collapsed``.

    The collapsed text, words joined by one blank, stands in place of the text. A run
    must have three periods at least, so that its seeds are within half their prefix.
    """
    if least_power < 3:
        raise ValueError("runs of less than three periods are not looked for")
    docs = without(docs, *({"runs", "collapsed"} - {text}))
    index = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    arrow_runs = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(index).to_pylist()]
        first = size = 0
        for k, t in enumerate([*held, None]):
            if t is None or (size and size + len(t) > GROUP_WORDS):
                part = held[first:k]
                runs = runs_of(part, least_length, least_power)
                kept = [b" ".join(collapsed(w, r)) for w, r in zip(part, runs)]
                columns = [batch.column(c).slice(first, k - first) for c in range(batch.num_columns) if c != index]
                columns.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], arrow_runs))
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "runs", "collapsed"])
                first, size = k, 0
            size += len(t or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from finish(batch)

    return docs.mapInArrow(run, schema)


def made_periodic(number: Column, text: Column) -> Column:
    """The text with a periodic end, for one number in ten; the words decide where.

    With h the CRC of the number's digits and n words, words from a = (h div 10) % n on
    repeat the next p = 1 + (n - a) div (3 + h div 10 % 8) of them.
    """

    def rewrite(held: Column) -> Column:
        h, n = F.crc32(number.cast("string").cast("binary")), F.size(held)
        g = F.floor(h / 10).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        unit = F.slice(held, a + 1, p)
        end = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(held, F.lit(1), a), end), " ")).otherwise(F.lit(""))

    chosen = F.crc32(number.cast("string").cast("binary")) % 10 == 0
    return F.when(chosen, let(words(text_of(text)), rewrite)).otherwise(text_of(text))


def run_table(docs: DataFrame) -> DataFrame:
    """Digest of the runs of every document: the greatest one, all of them, what is left.

    Documents without an id keep their text as it is; the others may be made periodic.
    """
    given = docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(given)
    # Greatest length / period; the first one, by start and period, among equal ones.
    greatest = F.aggregate(
        F.col("runs"),
        F.get("runs", F.lit(0)),
        lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", greatest.alias("top"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
