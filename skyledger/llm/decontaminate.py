"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word trigrams of a test item that are rare in the corpus join passages to the
item; the words around a seed are aligned to the item's words. A word edited,
dropped or added costs a little of the score and does not hide the copy.

Rare is relative: a trigram is a seed if few documents hold it, or not many times
as many as hold the middle one of its item. So common phrases start no alignments,
while an item copied into a third of all documents keeps its trigrams as seeds.

The test items are the stated query set. They are taken in blocks of bounded
size, each of which is broadcast and held against all documents where these are
read; documents are never shuffled.

A copy has at least a few of the item's words in order. Of an item with fewer words
than that, only all of them in a row are a copy, and only if few documents hold
them: a common word or name is no leak.

Edge cases: null or empty texts and items match nothing. Repeated documents or items give repeated
rows. Null ids stay as they are. Without items, no document is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import text_of

#: Words of a seed.
GRAM = 3
#: Documents that may hold a rare trigram in any case: so many, and this share of
#: all; and so many times those that hold the middle trigram of its item.
RARE_DOCUMENTS, RARE_SHARE, RARE_TIMES = 100, 1e-4, 4
#: Score of equal words, of different ones, and of a word on one side only.
EQUAL, DIFFERENT, GAP = 2, -1, -1
#: Least score of a copy, as a share of the score of the item with itself.
LEAST_SCORE = 0.5
#: Least words of an item that a copy has in order; shorter items are copied as a whole.
LEAST_WORDS = 6
#: UTF-8 bytes of the items of a block.
BLOCK_BYTES = 16 << 20

# ASCII letters, digits and the bytes of other characters make words.
_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PUNCTUATION = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; blanks and punctuation are between words."""
    text = (text or "").lower()
    if not text.isascii() and _PUNCTUATION.search(text):
        text = _PUNCTUATION.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def align(
    item: np.ndarray, passage: np.ndarray, equal: int = EQUAL, different: int = DIFFERENT, gap: int = GAP
) -> tuple[int, int]:
    """Best local alignment: its score, and where it ends in the passage.

    One step per word of the item. Gaps in the item's words are a running
    maximum, as a gap costs the same for every word.
    """
    steps = np.arange(len(passage) + 1, dtype=np.int64) * -gap
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, equal, different)
        above = row + gap
        row = np.maximum(above, 0)
        row[1:] = np.maximum(row[1:], diagonal)
        row = np.maximum.accumulate(row + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Items:
    """A block of test items, with what is needed to find and align copies."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        held = [(i, words_of(t)) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
        held = [(i, w) for i, w in held if w]
        names = sorted({w for _, ws in held for w in ws})
        self.vocabulary = {w: k for k, w in enumerate(names)}
        # Odd, so that no word drops out of a code that wraps around.
        self.base = (len(names) + 1) | 1
        self.ids = [i for i, _ in held]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in held]
        self.distinct = [np.unique(w, return_counts=True) for w in self.words]
        self.short_widths = sorted({len(w) for w in self.words if len(w) < LEAST_WORDS})
        base = [self._grams(w) for w in self.words]
        self.grams = np.unique(np.concatenate(base)) if base else np.empty(0, np.int64)
        places: list[list[tuple[int, int]]] = [[] for _ in self.grams]
        for k, grams in enumerate(base):
            for at, g in enumerate(np.searchsorted(self.grams, grams)):
                places[g].append((k, at))
        self.places = places
        self.seed = np.ones(len(self.grams), bool)
        # Short items that many documents hold; a longer item may have the same seed.
        self.common: set[int] = set()

    def _grams(self, coded: np.ndarray) -> np.ndarray:
        """Codes of an item's trigrams; of a short item, the code of all its words.

        A block has under two million different words, so a trigram fits 64 bits.
        Longer codes wrap around and may be equal by chance; the alignment decides.
        """
        width = GRAM if len(coded) >= LEAST_WORDS else len(coded)
        count = len(coded) - width + 1
        code = np.zeros(count, np.int64)
        for k in range(width):
            code = code * self.base + coded[k : k + count] + 1
        return code

    def code(self, text: str | None) -> np.ndarray:
        """The words as numbers, -1 for those no item has."""
        return np.array(list(map(self.vocabulary.get, words_of(text), repeat(-1))), np.int64)

    def held_grams(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the trigram) of the items' trigrams."""
        found_at, found = [], []
        for width in sorted({GRAM, *self.short_widths}):
            if width > len(coded):
                continue
            # Places from which as many known words follow.
            known = coded >= 0
            at = known[: len(coded) - width + 1].copy()
            for k in range(1, width):
                at &= known[k : len(coded) - width + 1 + k]
            at = np.flatnonzero(at)
            if not len(at):
                continue
            code = np.zeros(len(at), np.int64)
            for k in range(width):
                code = code * self.base + coded[at + k] + 1
            number = np.searchsorted(self.grams, code)
            number[number == len(self.grams)] = 0
            hit = self.grams[number] == code
            found_at.append(at[hit])
            found.append(number[hit])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def keep_rare(self, holders: dict[int, int], documents: int) -> None:
        """Choose the seeds by the number of documents that hold each trigram."""
        frequency = np.array([holders.get(g, 0) for g in range(len(self.grams))], np.int64)
        self.seed = np.zeros(len(self.grams), bool)
        of_item: list[list[int]] = [[] for _ in self.words]
        for g, places in enumerate(self.places):
            for k, _ in places:
                of_item[k].append(g)
        rare = max(RARE_DOCUMENTS, RARE_SHARE * documents)
        for k, grams in enumerate(of_item):
            own = frequency[grams]
            short = len(self.words[k]) < LEAST_WORDS
            if short and own.max() > rare:
                self.common.add(k)
            limit = rare if short else max(rare, RARE_TIMES * float(np.median(own)))
            self.seed[np.array(grams)[own <= limit]] = True

    def copies(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item number, score, first and end word of the best passage) for items copied."""
        coded = self.code(text)
        at, grams = self.held_grams(coded)
        keep = self.seed[grams] if len(grams) else np.empty(0, bool)
        windows: dict[int, set[int]] = {}
        for place, g in zip(at[keep].tolist(), grams[keep].tolist(), strict=True):
            for k, offset in self.places[g]:
                if k in self.common:
                    continue
                # Places of one copy differ little; a window takes in all of them.
                span = len(self.words[k])
                windows.setdefault(k, set()).add((place - offset) // span)
        found = []
        for k, starts in windows.items():
            item = self.words[k]
            best = self._best(k, coded, sorted(starts))
            if best[0] >= (LEAST_SCORE if len(item) >= LEAST_WORDS else 1.0):
                found.append((k, *best))
        return found

    def _shared(self, k: int, passage: np.ndarray) -> int:
        """Words of the item that the passage has as well, which bound the score."""
        own, counts = self.distinct[k]
        at = np.searchsorted(own, passage)
        at[at == len(own)] = 0
        held = np.bincount(at[own[at] == passage], minlength=len(own))
        return int(np.minimum(held, counts).sum())

    def _best(self, k: int, coded: np.ndarray, starts: list[int]) -> tuple[float, int, int]:
        item = self.words[k]
        span, most = len(item), EQUAL * len(item)
        best = (0.0, 0, 0)
        for s in starts:
            low, high = max(0, (s - 1) * span), min(len(coded), (s + 3) * span)
            if EQUAL * self._shared(k, coded[low:high]) < LEAST_SCORE * most:
                continue
            score, end = align(item, coded[low:high])
            if score / most > best[0]:
                if LEAST_SCORE * most < EQUAL * LEAST_WORDS <= most:
                    # So low a score may come from too few words.
                    _, length = align(item[::-1], coded[low : low + end][::-1])
                    in_order, _ = align(item, coded[low + end - length : low + end], 1, 0, 0)
                    if in_order < LEAST_WORDS:
                        continue
                _, length = align(item[::-1], coded[low : low + end][::-1])
                best = (score / most, low + end - length, low + end)
            if best[0] == 1.0:
                break
        return best


def _blocks(benchmark: DataFrame) -> Iterator[DataFrame]:
    """The items in blocks of about bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(F.col("text")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)


def _text_of_batch(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def prepared(docs: DataFrame, block: DataFrame) -> Items:
    """The items of a block with their seeds, after counting trigrams in all documents."""
    items = Items([(r.item_id, r.text) for r in block.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared.value.grams), np.int64)
        documents = 0
        for batch in batches:
            for text in _text_of_batch(batch):
                documents += 1
                _, grams = shared.value.held_grams(shared.value.code(text))
                held[np.unique(grams)] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(held[some], documents))],
            names=["gram", "documents"],
        )

    texts = docs.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(count, "gram long, documents long").groupBy("gram").sum("documents")
    # At most one row per trigram of the block.
    holders = {r[0]: r[1] for r in sums.collect()}
    items.keep_rare(holders, holders.get(-1, 0))
    return items


def _with_items(docs: DataFrame, block: DataFrame) -> Callable[[], Items]:
    shared = docs.sparkSession.sparkContext.broadcast(prepared(docs, block))
    return lambda: shared.value


_FOUND = "doc_id long, item_id long, score double, begins long, ends long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, begins, ends) for every copy; places count words."""

    def found_in(block: DataFrame) -> DataFrame:
        items = _with_items(docs, block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, items().ids[k], round(score, 4), begin, end)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), _text_of_batch(batch), strict=True)
                    for k, score, begin, end in items().copies(text)
                ]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "score", "begins", "ends"],
                )

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return texts.mapInArrow(run, _FOUND)

    every = docs.sparkSession.createDataFrame([], _FOUND)
    for block in _blocks(benchmark):
        every = every.unionByName(found_in(block))
    return every


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of an item, with their columns as they were.

    Seeds are chosen by counts over all given documents, as in ``leaks``, so the blocks
    do not depend on each other: each costs one counting scan of ``docs``, and one last
    scan applies them all.
    """

    def without_copies(kept: DataFrame, block: DataFrame) -> DataFrame:
        items = _with_items(docs, block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not items().copies(text) for text in _text_of_batch(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return kept.mapInArrow(run, kept.schema)

    clean = docs
    for block in _blocks(benchmark):
        clean = without_copies(clean, block)
    return clean
