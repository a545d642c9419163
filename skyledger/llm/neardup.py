"""Near duplicates by a chosen-path similarity join over MinHash values.

A document is its set of word shingles. Under a random hash, the token of a set
with the least value is its minwise token, and two sets have the same one with
the probability of their Jaccard similarity. A tree branches all documents by
the minwise token of one hash: documents of a node chose the same tokens on the
path so far. Small nodes are compared exhaustively, large ones branch again by
another hash. Independent trees make up for pairs that a tree separates: with 14
trees a pair of similarity 0.8 is never together after one branching with
probability 1e-10, after two with 6e-7.

A large node branches by two hashes not yet used on its path, so a pair has two
chances to stay together on every level: at similarity 0.8 it is compared in one
tree with probability 0.75 at any depth, and missed by all trees with 4e-9.

A large node whose documents mostly make the same choice again is not split by
branching; nor is what is still large on the last level. Such a node is compared
whole. At first it is cut into blocks, each compared together with hubs from the
node, which links most variants of one text. Then all members that these links
leave outside the node's largest component meet all others, in pairs of blocks.
That takes few pairs for variants of one text; for many texts that share a passage
but are not similar it grows with the square of the node.

Copies are collapsed first: one class per sequence of words. In a node every
class is compared with every other by signature, but only a spanning selection of
the likely pairs is handed on and confirmed on full sets. Where these links leave
likely pairs of a node in different components, the classes concerned meet again
with their full sets, in all trees: those that such pairs tie together are a group,
the same group of several nodes is taken once, every pair of a group under
different labels is compared exactly, and links that join components are handed on.
So no likely pair of a node is left out, and a group of variants hands on a number
of pairs in proportion to its size. What can be missed are pairs that no tree
brings together, and those whose signatures agree too little to be likely.

Edge cases: texts without words have an empty set and are linked with nothing,
not even with each other. A text shorter than a shingle is one shingle. Documents
without an id are returned unlinked with null as component. Repeated rows are
copies. An empty table gives no rows. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored
from skyledger.llm.components import components

#: Independent trees, and MinHash values of a signature.
TREES, VALUES = 14, 96
#: Classes of a node that are compared with each other, and hubs of a larger one.
NODE, HUBS = 1024, 512
#: Levels below the root at which large nodes branch again.
LEVELS = 8
#: Hashes by which a large node branches.
WAYS = 2
#: Share of a node that makes the same choice, from which it is compared whole.
ALIKE = 0.6
#: A pair is likely if its signatures agree in at least the threshold less this
#: many standard deviations.
DEVIATIONS = 4.5
#: Members in the middle of a node that every other is tied to, if likely similar.
MIDDLES = 2
#: Words whose hashes a task remembers.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Similarity:
    """Sets of ``width``-word shingles; linked from ``percent`` of the union."""

    width: int
    percent: int

    @property
    def likely(self) -> int:
        p = self.percent / 100
        return int(VALUES * p - DEVIATIONS * (VALUES * p * (1 - p)) ** 0.5)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes lower-case and split by ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(held: list[bytes], width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; all words if they are fewer."""
    if not held:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in held], np.uint64)
    width = min(width, len(held))
    count = len(held) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = _mixed(total + h[k : k + count])
    return np.unique(total)


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.integers(0, 2**63, count, dtype=np.uint64), odd


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value under each hash, in slices of bounded memory."""
    flip, odd = _constants(VALUES)
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        part = tokens[at : at + 4096, None]
        np.minimum(least, ((part ^ flip) * odd).min(0), out=least)
    return least


_SIGNED = "doc_id long, text_hash long, key binary, n_shingles long, signature binary, roots array<long>"


def sign(docs: DataFrame, width: int) -> DataFrame:
    """Per row: key of its word sequence, set size, signature, nodes below the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        trees = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            keys, sizes, signatures, roots = [], [], [], []
            for text in batch.column("text").to_pylist():
                held = words_of(text)
                tokens = shingles(held, width, hashes)
                keys.append(xxhash.xxh3_128_digest(b" ".join(held)))
                sizes.append(len(tokens))
                if len(tokens):
                    least = minima(tokens)
                    signatures.append(least.astype("<u2").tobytes())
                    roots.append(_mixed(least[:TREES] + trees).view(np.int64))
                else:
                    signatures.append(b"")
                    roots.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(roots, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "key", "n_shingles", "signature", "roots"],
            )

    return _plain(docs).mapInArrow(run, _SIGNED)


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per word sequence: uid, rep (its least id), key, set size, signature, roots.

    ``rep_hash`` is the hash of a text under that id, of which there may be many.
    """
    linked = signed.where("doc_id is not null and n_shingles > 0")
    least = linked.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"), F.first("roots").alias("roots"),
    )
    named = least.withColumns({"rep": F.col("one.doc_id"), "rep_hash": F.col("one.text_hash")}).drop("one")
    return named.withColumn("uid", F.monotonically_increasing_id())


def _coordinates(level: int) -> list[list[int]]:
    """Per way and tree, the hash by which this level branches; none comes twice in a tree."""
    rng = np.random.default_rng(21)
    orders = [rng.permutation(np.delete(np.arange(VALUES), t)) for t in range(TREES)]
    return [[int(order[level * WAYS + way]) for order in orders] for way in range(WAYS)]


def _branch(rows: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """(tree, node, uid) with way and child: the node and the next chosen token."""

    def child(way: int, coordinates: list[int]) -> Column:
        which = F.get(F.array(*map(F.lit, coordinates)), F.col("tree"))
        chosen = F.substr("signature", which * 2 + 1, F.lit(2))
        return F.struct(F.lit(way).alias("way"), F.xxhash64("node", which, chosen).alias("child"))

    children = F.array(*[child(way, c) for way, c in enumerate(_coordinates(level))])
    tokens = rows.join(classes.select("uid", "signature"), "uid")
    return tokens.select("tree", "node", "uid", F.inline(children))


def _blocks(large: DataFrame) -> DataFrame:
    """(tree, node, uid, n) of large nodes as rows of blocks, the hubs of a node in each of its blocks."""
    count = F.ceil(F.col("n") / (NODE - HUBS)).cast("int")
    place = F.abs(F.xxhash64("uid", "node", F.lit("place")) % F.lit(1 << 40))
    # Hubs are drawn by hash: so many of the node as expected, whatever its size.
    hub = place < (F.lit(HUBS) * F.lit(1 << 40) / F.col("n"))
    own = F.array(F.pmod(F.xxhash64("uid", "node"), count.cast("long")).cast("int"))
    blocks = F.when(hub, F.sequence(F.lit(0), count - 1)).otherwise(own)
    spread = large.select("tree", "node", "uid", F.explode(blocks).alias("block"))
    return spread.select("tree", F.xxhash64("node", F.lit("block"), "block").alias("node"), "uid")


def _block_pairs(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, uid, label) of large nodes in pairs of blocks.

    Every two members of a node meet in a pair, but two of its most frequent label.
    """
    labelled = large.join(labels, "uid", "left").select("node", "uid", F.coalesce("label", "uid").alias("label"))
    labelled = stored(labelled, "dedup-labelled")
    counts = labelled.groupBy("node", "label").count()
    tops = counts.groupBy("node").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("n"))
    half = NODE // 2
    mixed = tops.where("top.count < n").select(
        "node",
        F.col("top.label").alias("main"),
        F.ceil((F.col("n") - F.col("top.count")) / half).alias("others"),
        F.ceil(F.col("top.count") / half).alias("mains"),
    )
    sized = labelled.join(stored(mixed, "dedup-mixed"), "node")
    # Blocks of other labels are numbered first; those of the main one meet only these.
    is_main = F.col("label") == F.col("main")
    place = F.xxhash64("uid", "node", F.lit("half"))
    own = F.when(is_main, F.col("others") + F.pmod(place, "mains")).otherwise(F.pmod(place, "others"))
    last = F.col("others") - 1 + F.when(is_main, F.lit(0)).otherwise(F.col("mains"))
    met = sized.select("node", "uid", "label", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("met"))
    pair = F.xxhash64("node", F.lit("pair"), F.least("own", "met"), F.greatest("own", "met"))
    return met.where("own <> met").select(pair.alias("node"), "uid", "label")


def nodes_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, uid) of all small nodes, and with n of the large ones to compare whole."""
    member = ("tree", "node", "uid")
    rows = classes.select(F.posexplode("roots").alias("tree", "node"), "uid")
    found, whole = [], []
    for level in range(LEVELS + 1):
        rows = stored(rows, "dedup-level")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        sizes = stored(sizes, "dedup-sizes")
        found.append(rows.join(sizes.where(F.col("n") <= NODE), "node").select(*member))
        large = sizes.where(F.col("n") > NODE)
        kept = rows.join(large, "node").select(*member, "n")
        if level == LEVELS:
            whole.append(kept)
        if level == LEVELS or large.isEmpty():
            break
        branched = stored(_branch(kept, classes, level), "dedup-branch")
        ways = branched.groupBy("node", "way", "child").count().groupBy("node", "way").agg(F.max("count").alias("most"))
        least = ways.groupBy("node").agg(F.min("most").alias("most"))
        alike = large.join(least, "node").where(F.col("most") >= ALIKE * F.col("n"))
        alike = stored(alike.select("node"), "dedup-alike")
        whole.append(kept.join(alike, "node").select(*member, "n"))
        rows = branched.join(alike, "node", "left_anti").select("tree", F.col("child").alias("node"), "uid")
    none = classes.select(F.lit(0).alias("tree"), *[F.lit(0).cast("long").alias(c) for c in ("node", "uid", "n")])
    whole.append(none.where("false"))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, whole)


def _agreeing(signatures: np.ndarray, sizes: np.ndarray, like: Similarity) -> Iterator[tuple]:
    """(i, js, agreements): for every i the later members that are likely similar."""
    for i in range(len(sizes) - 1):
        own, rest = sizes[i], sizes[i + 1 :]
        fits = 100 * np.minimum(own, rest) >= like.percent * np.maximum(own, rest)
        js = np.flatnonzero(fits) + i + 1
        if len(js):
            agreed = (signatures[js] == signatures[i]).sum(1)
            keep = agreed >= like.likely
            if keep.any():
                yield i, js[keep], agreed[keep]


def _spanning(signatures: np.ndarray, sizes: np.ndarray, like: Similarity) -> set[tuple[int, int]]:
    """Few likely pairs that connect what is likely similar.

    Members are taken in order of how much they agree with others. Each is tied
    to the one with which it agrees most, and to the first two it is likely
    similar to: variants of a text differ most from each other and least from
    those in their middle.
    """
    n = len(sizes)
    if n == 2:
        return {(0, 1)} if any(True for _ in _agreeing(signatures, sizes, like)) else set()
    rows = list(_agreeing(signatures, sizes, like))
    if not rows:
        return set()
    agreement = np.zeros((n, n), np.uint8)
    for i, js, agreed in rows:
        agreement[i, js] = agreed
        agreement[js, i] = agreed
    order = np.lexsort((np.arange(n), -agreement.sum(1, dtype=np.int64)))
    ranked = agreement[np.ix_(order, order)]
    chosen = [ranked.argmax(1)]
    likely = ranked > 0
    for _ in range(MIDDLES):
        chosen.append(likely.argmax(1))
        likely[np.arange(n), chosen[-1]] = False
    pairs = set()
    for best in chosen:
        for k in np.flatnonzero(ranked[np.arange(n), best]):
            pairs.add((int(order[k]), int(order[best[k]])))
    return pairs


def _crossing(
    signatures: np.ndarray, sizes: np.ndarray, labels: np.ndarray, like: Similarity
) -> np.ndarray:
    """Per member a number of its group, -1 without one.

    Groups are what likely pairs under different labels tie together.
    """
    n = len(sizes)
    group = np.arange(n)
    concerned = np.zeros(n, bool)
    if (labels != labels[0]).any():
        for i, js, _ in _agreeing(signatures, sizes, like):
            js = js[labels[js] != labels[i]]
            if len(js):
                concerned[js] = True
                concerned[i] = True
                joined = np.zeros(n, bool)
                joined[group[js]] = True
                group[joined[group]] = group[i]
    return np.where(concerned, group, -1)


def _joining(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that are similar enough and join labels, each only if not joined before.

    Tokens are numbered; one pass over the tokens of all members counts what they
    share with one of them.
    """
    sizes = np.array([len(t) for t in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(codes.max() + 1, np.int32)
    now = labels.copy()
    found = []
    for i in range(len(sets) - 1):
        if (now[i + 1 :] == now[i]).all():
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        similar = 100 * shared >= percent * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(similar[i + 1 :]) + i + 1:
            if now[j] != now[i]:
                found.append((i, int(j)))
                now[now == now[j]] = now[i]
    return found


def _by_node(
    members: DataFrame, schema: str, use: Callable[[pa.Table], pa.RecordBatch | None]
) -> DataFrame:
    """``use`` on the rows of every node with more than one row.

    Nodes come sorted; the last of a batch may go on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def whole(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            node = rows.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            ends = cuts if last else cuts[:-1]
            out = [
                done
                for s, e in zip(ends, ends[1:], strict=False)
                if e - s > 1 and (done := use(rows.slice(s, e - s))) is not None
            ]
            held = None if last else rows.slice(ends[-1])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
                yield from whole(rows, last=False)
        if held is not None and held.num_rows:
            yield from whole(held, last=True)

    return members.repartition("node").sortWithinPartitions("node", "uid").mapInArrow(run, schema)


def _described(node: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(node.column("signature").to_pylist())
    signatures = np.frombuffer(joined, "<u2").reshape(node.num_rows, VALUES)
    return signatures, node.column("n_shingles").to_numpy()


def _ends(node: pa.Table, pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch | None:
    """Pairs of places as pairs of uids, the lesser first."""
    at = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    if not len(at):
        return None
    uid = node.column("uid").to_numpy()[at]
    columns = [pa.array(uid.min(1)), pa.array(uid.max(1))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def spanning_pairs(members: DataFrame, like: Similarity) -> DataFrame:
    """Likely pairs (a, b) to confirm, from (node, uid, n_shingles, signature)."""
    found = _by_node(members, "a long, b long", lambda node: _ends(node, _spanning(*_described(node), like)))
    return found.distinct()


def crossing_members(members: DataFrame, like: Similarity) -> DataFrame:
    """(node, uid, label) in likely pairs under different labels.

    A node here is a group, named by its members, so that the same group found in
    several nodes is one.
    """

    def use(node: pa.Table) -> pa.RecordBatch | None:
        group = _crossing(*_described(node), node.column("label").to_numpy(), like)
        if (group < 0).all():
            return None
        uid = node.column("uid").to_numpy()
        name = np.zeros(len(uid), np.int64)
        for g in np.unique(group[group >= 0]):
            # Members come sorted by uid.
            digest = xxhash.xxh3_64_intdigest(uid[group == g].tobytes())
            name[group == g] = np.uint64(digest).astype(np.int64)
        named = [pa.array(name), pa.array(uid), node.column("label").combine_chunks()]
        found = pa.Table.from_arrays(named, names=["node", "uid", "label"]).filter(pa.array(group >= 0))
        return found.combine_chunks().to_batches()[0]

    return _by_node(members, "node long, uid long, label long", use).distinct()


def joining_links(members: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) between labels, from (node, uid, label, tokens)."""

    def use(node: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(t, np.uint64) for t in node.column("tokens").to_pylist()]
        return _ends(node, _joining(sets, node.column("label").to_numpy(), percent))

    return _by_node(members, "a long, b long", use)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, key, text) of wanted (uid, rep, rep_hash, key).

    Texts are found by id and hash, so an id with many texts gives each its own class.
    """
    named = wanted.withColumnsRenamed({"rep": "doc_id", "rep_hash": "text_hash"})
    return _plain(docs).join(named, ["doc_id", "text_hash"]).select("uid", "key", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(uid, tokens) of wanted (uid, rep, rep_hash, key), the set as bytes, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            uids, tokens = [], []
            columns = (batch.column(c).to_pylist() for c in ("uid", "key", "text"))
            for uid, key, text in zip(*columns, strict=True):
                held = words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(held)) == key:
                    uids.append(uid)
                    tokens.append(shingles(held, width, hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids, pa.int64()), pa.array(tokens, pa.binary())], names=["uid", "tokens"]
            )

    found = texts_of(docs, wanted).mapInArrow(run, "uid long, tokens binary")
    return found.dropDuplicates(["uid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (u, v) if len(u) < len(v) else (v, u)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                shared = int((large[at] == small).sum())
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    of_a = sets.select(F.col("uid").alias("a"), F.col("tokens").alias("of_a"))
    of_b = sets.select(F.col("uid").alias("b"), F.col("tokens").alias("of_b"))
    return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(run, "a long, b long")


def links_of(docs: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): every class with a link, but the least of its component, with that least."""
    described = classes.select("uid", "n_shingles", "signature")
    small, large = (stored(rows, "dedup-nodes") for rows in nodes_of(classes))
    members = small.unionByName(_blocks(large)).join(described, "uid")
    first = stored(spanning_pairs(members, like), "dedup-pairs")
    # In small nodes every class with a likely partner is an end of one of these pairs.
    ends = first.select(F.col("a").alias("uid")).union(first.select("b")).distinct()
    wanted = classes.select("uid", "rep", "rep_hash", "key")
    sets = stored(sets_of(docs, wanted.join(ends, "uid"), like.width), "dedup-sets")
    links = stored(confirmed(first, sets, like.percent), "dedup-links")
    labels = components(links).select(F.col("a").alias("uid"), F.col("b").alias("label"))
    again = small.join(ends, "uid").join(labels, "uid", "left")
    again = again.select("node", "uid", F.coalesce("label", "uid").alias("label"))
    again = again.unionByName(_block_pairs(large, labels))
    concerned = stored(crossing_members(again.join(described, "uid"), like), "dedup-crossing")
    late = concerned.select("uid").distinct().join(ends, "uid", "left_anti")
    late = stored(wanted.join(late, "uid"), "dedup-late")
    if not late.isEmpty():
        sets = sets.unionByName(stored(sets_of(docs, late, like.width), "dedup-sets"))
    more = joining_links(concerned.join(sets, "uid"), like.percent)
    return components(links.unionByName(more))


def _placed(docs: DataFrame, like: Similarity) -> DataFrame:
    """Per row: doc_id, n_shingles, key of its word sequence, component_id, and chosen.

    ``chosen`` holds for one (doc_id, key) of a component, the least, and for rows
    without an id or without words.
    """
    signed = stored(sign(docs, like.width), "dedup-signed")
    classes = stored(classes_of(signed), "dedup-classes")
    tied = links_of(docs, classes, like)
    root = classes.select("uid", "key", "rep").join(
        tied.select(F.col("a").alias("uid"), F.col("b").alias("root")), "uid", "left"
    ).withColumn("root", F.coalesce("root", "uid"))
    root = stored(root, "dedup-roots")
    least = root.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("least"))
    by_key = root.join(least, "root").select("key", "least")
    rows = signed.select("doc_id", "key", "n_shingles").join(by_key, "key", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.struct(F.col("doc_id").alias("rep"), "key")
    return rows.select(
        "doc_id",
        "n_shingles",
        "key",
        F.when(linked, F.col("least.rep")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, own == F.col("least")).otherwise(F.lit(True)).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, like: Similarity) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and the key of its word sequence."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _placed(docs, like).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "key")


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the key of each row's word sequence, null without an id or words.

    The words of one text are held at a time; those of a batch take many times its size.
    """

    def key_of(doc: int | None, text: str | None) -> bytes | None:
        held = words_of(text) if doc is not None else []
        return xxhash.xxh3_128_digest(b" ".join(held)) if held else None

    added = docs.withColumn(key, F.lit(None).cast("binary"))
    schema = added.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            keys = list(map(key_of, ids, texts))
            columns = [*batch.columns[:-1], pa.array(keys, batch.schema.field(key).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return added.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, like: Similarity) -> DataFrame:
    """One document of each component, the one of least id and then of least key.

    An id may stand for several texts; each is judged for itself. Of rows with this
    id and word sequence the least text stays, once; of rows alike in these, but not in
    other columns, the one whose row has the least hash. Rows without words stay once
    for each id and text; rows without an id stay as they are.
    """
    columns = docs.columns
    gone = _placed(docs, like).where("not chosen").select(
        F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")
    ).distinct()
    own = "sequence of words"
    keyed = _with_key(docs, own)
    same = (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.col(own) == F.col("gone_key"))
    kept = keyed.join(gone, same, "left_anti")
    # Rows without words have no key and are told apart by their text.
    apart = F.when(F.col(own).isNull(), F.col("text"))
    named = kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id"), F.col(own).alias("of_key"), apart.alias("of_text"))
    first = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*columns))
    one = named.agg(F.min_by(F.struct(*columns), first).alias("one")).select("one.*")
    return one.unionByName(kept.where("doc_id is null").select(*columns)).select(*columns)
