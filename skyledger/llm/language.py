"""Log-probabilities of texts under a log-bilinear neural language model.

The model predicts a word from the two before it. Each place before has a vector for
every word; their sum is multiplied with the vector of each possible next word, and a
bias is added. It predicts the ``SHORTLIST`` most frequent tokens and one class for all
others; within that class a word has its share of smoothed counts, as in the base. So
the probabilities of all V counted tokens and of one slot for unknown words sum to 1.

Training is noise-contrastive: the model learns to tell the next word from words drawn
by frequency, which needs no sum over the vocabulary. Every task trains on the words it
reads, all training texts take part, and parameters are averaged by the number of
tokens, in ``ROUNDS`` passes over disjoint parts of the texts. Scoring then divides by the
true sums: contexts of a group of texts are taken once each, and a batched matrix
product gives all their scores.

Counts are exact, over all training texts. Tokens with at least a ``HEAD``-th of all
counts, at most ``HEAD`` of them and each bounded in length, are broadcast. The others
meet their counts in a join, where none of them can be hot: each has less than that
share of the training tokens, and a text brings each once.

Edge cases: null, empty and blank texts have the end token alone. Texts without an id
are held out, as their digits are the empty text. Repeated rows are scored, and learned
from, as often as they are there. Without training texts every token has the
probability of the unknown slot, which is 1.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import stored, text_of, without

#: Tokens the network tells apart (under 2**16), and numbers in a vector.
SHORTLIST, WIDTH = 1024, 32
#: The tokens broadcast are those with at least this part of all counts.
HEAD = 1 << 20
#: UTF-8 bytes of a word that is its own key; a longer one goes by its digest.
KEY_BYTES = 64
#: Noise words of a training batch, its tokens, and the step.
NOISE, BATCH, STEP = 64, 1024, 0.15
#: Tokens of the texts that are worked on at once.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 18, 1 << 20
#: Keys a task counts before it gives its counts on; one text may add its own.
COUNTED = 1 << 18
#: Remainders (of ten) of the texts learned from, by round; remainder 0 is held out.
ROUNDS = ((1,), (2, 3, 4, 5, 6, 7, 8, 9))
SMOOTHING = 0.1

#: Key of the end of a text; no word is empty.
END = ""


def key_of(word: bytes) -> bytes:
    """What a word is counted by; the blank keeps digests apart from words."""
    return word if len(word) <= KEY_BYTES else b" " + hashlib.sha256(word).hexdigest().encode()


def remainder(number: Column) -> Column:
    """Which tenth a text belongs to; 0 is held out."""
    return F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 10


@dataclass
class Network:
    """Vectors of the two words before, vectors and biases of the next one.

    Row ``size`` stands for all other words, row ``size + 1`` of ``before`` for the
    place before a text.
    """

    before: np.ndarray  # 2 x (size + 2) x width
    after: np.ndarray  # (size + 1) x width
    bias: np.ndarray  # size + 1

    @classmethod
    def start(cls, shares: np.ndarray, width: int, seed: int = 0) -> Network:
        """Small random vectors, and biases that give each class its share."""
        draw, n = np.random.default_rng(seed), len(shares)
        before = draw.normal(0, 0.1, (2, n + 1, width)).astype(np.float32)
        after = draw.normal(0, 0.1, (n, width)).astype(np.float32)
        return cls(before, after, np.log(shares).astype(np.float32))

    @property
    def size(self) -> int:
        return len(self.bias) - 1

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.before[0][first] + self.before[1][second]

    def log_sums(self, first: np.ndarray, second: np.ndarray, rows: int = 256) -> np.ndarray:
        """Logarithm of the sum of all next words' exponentiated scores, by context."""
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), rows):
            part = slice(at, at + rows)
            scores = self.predicted(first[part], second[part]) @ self.after.T
            scores += self.bias
            top = scores.max(axis=1, keepdims=True)
            np.exp(scores - top, out=scores)
            out[part] = np.log(scores.sum(axis=1)) + top[:, 0]
        return out

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each next word; contexts are normalised once each."""
        code = first.astype(np.int64) * (self.size + 2) + second
        seen = np.zeros((self.size + 2) ** 2, bool)  # a flag a context costs less than sorting
        seen[code] = True
        known = np.flatnonzero(seen)
        place = np.empty(len(seen), np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        at = place[code]
        u, v = np.divmod(known, self.size + 2)
        sums, predicted = self.log_sums(u, v), self.predicted(u, v)
        out = np.empty(len(target), np.float32)
        for start in range(0, len(target), 1 << 15):
            part = slice(start, start + (1 << 15))
            out[part] = np.einsum("ij,ij->i", predicted[at[part]], self.after[target[part]])
        return out + self.bias[target] - sums[at]


class Training:
    """Noise-contrastive steps on a copy of a network, with Adagrad."""

    def __init__(self, network: Network, shares: np.ndarray, seed: int):
        self.net = Network(*(x.copy() for x in (network.before, network.after, network.bias)))
        self.draw = np.random.default_rng(seed)
        self.heights = np.cumsum(shares)
        self.offset = np.log(NOISE * shares).astype(np.float32)
        self.past = [np.full_like(x, 1e-2) for x in (self.net.before, self.net.after, self.net.bias)]
        self.tokens = 0

    @staticmethod
    def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that are there, once each and in order, and the sums of their values."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits sort by digits
        held = rows[order]
        firsts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        return held[firsts], np.add.reduceat(values[order], firsts, axis=0)

    @staticmethod
    def _move(value: np.ndarray, past: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Adagrad on the rows a batch touches; the others have no gradient and stay."""
        height = past[rows] + gradient * gradient
        past[rows] = height
        value[rows] += STEP * gradient / np.sqrt(height)

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        """One batch: every token against the same noise words."""
        net, n = self.net, self.net.size + 1
        noise = np.minimum(np.searchsorted(self.heights, self.draw.random(NOISE) * self.heights[-1]), n - 1)
        predicted = net.predicted(first, second)
        own, others = net.after[target], net.after[noise]
        true = np.einsum("ij,ij->i", predicted, own) + net.bias[target] - self.offset[target]
        false = predicted @ others.T
        false += net.bias[noise] - self.offset[noise]
        # Gradients of the log-likelihood of "from the text" and "from the noise".
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = np.negative(false, out=false)  # the largest table of a batch: worked on in place
        np.exp(np.clip(down, -30, 30, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        pull = up[:, None] * own
        pull += down @ others
        grow = np.zeros((n, net.after.shape[1] + 1), np.float32)
        np.add.at(grow, noise, np.hstack([down.T @ predicted, down.sum(axis=0)[:, None]]))
        own_rows, own_sums = self._sums(target, np.hstack([up[:, None] * predicted, up[:, None]]))
        grow[own_rows] += own_sums
        touched = np.zeros(n, bool)
        touched[own_rows] = touched[noise] = True
        rows = np.flatnonzero(touched)
        scale = len(target) ** 0.5
        before, after, bias = self.past
        for place, words in enumerate((first, second)):
            held, sums = self._sums(words, pull)
            self._move(net.before[place], before[place], held, sums / scale)
        gradient = grow[rows] / scale
        self._move(net.after, after, rows, gradient[:, :-1])
        self._move(net.bias, bias, rows, gradient[:, -1])

    def learn(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        """All tokens once, in random order."""
        order = self.draw.permutation(len(target))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            self.step(first[part], second[part], target[part])
        self.tokens += len(target)


@dataclass
class Vocabulary:
    """Exact counts: of all training tokens, and of the frequent ones one by one."""

    tokens: int
    distinct: int
    head: dict[bytes, int]  # place by key, most frequent first
    counts: np.ndarray
    size: int = field(default=0)  # the shortlist: so many first places

    @property
    def mass(self) -> float:
        """What smoothed counts are divided by."""
        return self.tokens + SMOOTHING * (self.distinct + 1)

    @property
    def rest(self) -> float:
        """Smoothed counts of all tokens outside the shortlist and of the unknown slot."""
        listed = int(self.counts[: self.size].sum())
        return self.tokens - listed + SMOOTHING * (self.distinct - self.size + 1)

    def shares(self) -> np.ndarray:
        """Of the shortlist, one by one, and of all else."""
        return np.append(self.counts[: self.size] + SMOOTHING, self.rest) / self.mass


def count_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """``key`` and ``c`` of every token of the texts; summed before the shuffle.

    A task adds up its words in a table that is given on when it holds ``COUNTED`` keys,
    so its size does not depend on the texts. Spark sums what the tasks give.
    """

    def given(counted: Counter) -> pa.RecordBatch:
        keys = pa.array(list(counted), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([keys, pa.array(list(counted.values()), pa.int64())], ["key", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for group in _by_tokens(batches, 0, TRAIN_TOKENS):
            counted[END.encode()] += group.num_rows
            for text in group.column(0).cast(pa.binary()).to_pylist():
                found = text.lower().split()
                if len(text) > KEY_BYTES and max(map(len, found), default=0) > KEY_BYTES:
                    found = map(key_of, found)
                counted.update(found)
                if len(counted) >= COUNTED:
                    yield given(counted)
                    counted.clear()
        if counted:
            yield given(counted)

    counts = texts.select(text_of(F.col(text)).alias("text")).mapInArrow(count, "key string, c long")
    return counts.groupBy("key").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, shortlist: int = SHORTLIST, head: int = HEAD) -> Vocabulary:
    """The totals and the frequent tokens of a stored table of counts."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = counts.where(F.col("c") * head >= total.n).toArrow()
    held = sorted(zip(frequent["c"].to_pylist(), frequent["key"].to_pylist()), key=lambda x: (x[1] != END, -x[0], x[1]))
    places = {key.encode(): k for k, (_, key) in enumerate(held)}
    return Vocabulary(total.n, total.v, places, np.array([c for c, _ in held], np.int64), min(shortlist, len(held)))


def _tokens(texts: pa.Array, places: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, places of all tokens (-1: not frequent) and each text's number."""
    held = [t.lower().split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(w) + 1 for w in held])
    out = np.full(int(sizes.sum()), places.get(END.encode(), -1))
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes) - 1] = False
    found = map(places.get, chain.from_iterable(held), repeat(-1))
    out[is_word] = np.fromiter(found, np.int64, len(out) - len(held))
    return held, out, np.repeat(np.arange(len(held)), sizes)


def _contexts(place: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the two tokens before and of each token itself."""
    own = np.where((place >= 0) & (place < size), place, size)
    padded = np.append([size + 1, size + 1], own)
    number = np.append([-1, -1], text)
    first = np.where(number[:-2] == text, padded[:-2], size + 1)
    second = np.where(number[1:-1] == text, padded[1:-1], size + 1)
    return first, second, own


def _by_tokens(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about so many tokens, guessed by bytes; across batches."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        first = 0
        for k, length in enumerate((lengths // 6 + 1).tolist()):
            if size and size + length > most:
                waiting.append(batch.slice(first, k - first))
                yield joined()
                waiting, size, first = [], 0, k
            size += length
        if first < batch.num_rows:
            waiting.append(batch.slice(first))
    if size:
        yield joined()


def _values(network: Network) -> list[tuple[int, np.ndarray]]:
    """The tables of a network, biases as a last column of the vectors of next words."""
    after = np.hstack([network.after, network.bias[:, None]])
    pad = np.zeros((*network.before.shape[:2], 1), np.float32)
    return [*enumerate(np.concatenate([network.before, pad], axis=2)), (2, after)]


def train(texts: DataFrame, words_of: Vocabulary, tenth: str, text: str = "text", width: int = WIDTH) -> Network:
    """A network learned from all texts whose ``tenth`` is in a round."""
    shares = words_of.shares()
    network = Network.start(shares, width)
    spark = texts.sparkSession.sparkContext
    schema = "part int, row int, tokens long, value array<float>"
    for tenths in ROUNDS:
        given = spark.broadcast((network, words_of.head, words_of.size, shares))

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            start, places, size, shares = given.value
            training = Training(start, shares, TaskContext.get().partitionId())
            for group in _by_tokens(batches, 0, TRAIN_TOKENS):
                _, place, number = _tokens(group.column(0), places)
                training.learn(*_contexts(place, number, size))
            if not training.tokens:
                return
            for part, table in _values(training.net):
                n = len(table)
                values = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1])
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n, dtype=np.int32))]
                columns += [pa.array(np.full(n, training.tokens)), values.cast(pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "row", "tokens", "value"])

        learned = texts.where(F.col(tenth).isin(*tenths)).select(text_of(F.col(text)).alias("text"))
        tasks = learned.mapInArrow(learn, schema)
        means = [(F.sum(F.col("value")[d] * F.col("tokens")) / F.sum("tokens")).alias(f"v{d}") for d in range(width + 1)]
        held = tasks.groupBy("part", "row").agg(*means).orderBy("part", "row").toArrow()
        if held.num_rows:
            rows = np.column_stack([held[f"v{d}"].to_numpy() for d in range(width + 1)]).astype(np.float32)
            n = len(shares)
            before = np.stack([rows[: n + 1, :width], rows[n + 1 : 2 * n + 2, :width]])
            network = Network(before, rows[2 * n + 2 :, :width], rows[2 * n + 2 :, width].copy())
        given.unpersist()
    return network


_TAIL = pa.struct([pa.field("key", pa.string()), pa.field("n", pa.int64())])
#: What a task finds out about a text: of its frequent tokens, and its other words.
_MADE = {
    "n_tokens": "long",
    "n_known": "long",
    "listed": "double",
    "base": "double",
    "n_rest": "long",
    "rest": "double",
    "tail": "array<struct<key string, n long>>",
}


def score(texts: DataFrame, words_of: Vocabulary, counts: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``texts`` without the text, with n_tokens, n_known, base_score and score."""
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast((network, words_of.head, words_of.counts, words_of.size))
    texts = without(texts, *({*_MADE, "uid", "n_tail", "known_tail", "tail_base", "base_score", "score"} - {text}))
    others = [c for c in texts.columns if c != text]
    kept = T.StructType([texts.schema[c] for c in others])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {v}" for k, v in _MADE.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, places, counts, size = given.value
        logs = np.log10(counts + SMOOTHING)
        for group in _by_tokens(batches, group_column, SCORE_TOKENS):
            held, place, number = _tokens(group.column(group_column), places)
            n = len(held)
            listed = network.log_probabilities(*_contexts(place, number, size)) / math.log(10)
            frequent, unlisted = place >= 0, place >= size
            tails = _tails(held, place, number)

            def counted(chosen: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(number[chosen], minlength=n), pa.int64())

            def summed(chosen: np.ndarray, values: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(number[chosen], values, n).astype(float))

            columns = [c for k, c in enumerate(group.columns) if k != group_column]
            columns += [counted(place >= -1), counted(frequent), summed(place >= -1, listed)]
            columns += [summed(frequent, logs[place[frequent]]), counted(unlisted)]
            columns += [summed(unlisted, logs[place[unlisted]]), tails]
            yield pa.RecordBatch.from_arrays(columns, [*others, *_MADE])

    ordered = texts.select(*others, text_of(F.col(text)).alias(text))
    group_column = len(others)
    numbered = stored(ordered.mapInArrow(work, schema).withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = counts.where(F.col("c") * HEAD < words_of.tokens)
    tails = numbered.select("uid", F.explode("tail").alias("t")).select("uid", "t.key", "t.n")
    sums = (
        tails.join(rare, "key", "left")
        .groupBy("uid")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("tail_base"),
            F.sum("n").alias("n_tail"),
            F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known_tail"),
        )
    )
    none = F.lit(0)
    tail_base = F.coalesce("tail_base", F.lit(0.0))
    unlisted = F.col("n_rest") + F.coalesce("n_tail", none)
    return numbered.join(sums, "uid", "left").select(
        *others,
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_tail", none)).alias("n_known"),
        (F.col("base") + tail_base - F.col("n_tokens") * math.log10(words_of.mass)).alias("base_score"),
        (F.col("listed") + F.col("rest") + tail_base - unlisted * math.log10(words_of.rest)).alias("score"),
    )


def _tails(held: list[list[bytes]], place: np.ndarray, number: np.ndarray) -> pa.Array:
    """For each text its words that are not frequent, with how often they are there."""
    rare: list[list[bytes]] = [[] for _ in held]
    first = np.searchsorted(number, np.arange(len(held)))
    for k in np.flatnonzero(place < 0).tolist():
        t = number[k]
        at = k - first[t]
        rare[t].append(key_of(held[t][at]) if at < len(held[t]) else END.encode())
    counted = [Counter(r) for r in rare]
    keys = pa.array([k for c in counted for k in c], pa.binary()).cast(pa.string())
    times = pa.array([x for c in counted for x in c.values()], pa.int64())
    offsets = np.cumsum([0, *map(len, counted)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([keys, times], fields=list(_TAIL)))


def score_table(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every document, learned from nine tenths of them."""
    given = docs.select("doc_id", "text", remainder(F.col("doc_id")).alias("tenth"))
    counts = stored(count_tokens(given.where(F.col("tenth") != 0)), "tokens")
    known = vocabulary(counts)
    network = train(given, known, "tenth")
    scored = score(given.withColumn("held_out", F.col("tenth") == 0).drop("tenth"), known, counts, network)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
