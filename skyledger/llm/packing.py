"""Token ids packed into rows of one length.

Documents are turned to token ids, each closed by an end token, and cut into
parts of at most a row; no token is lost, and the parts in order give the document
back. Parts are scattered by hash into groups of bounded size, and each group is
packed best-fit-decreasing: the longest part first, each into the fullest row it
still fits in. A segment tree over free capacities finds that row in logarithmic
time.

A packed row holds its ids as little-endian bytes, padded to the row's length;
``cu_seqlens``, where its segments begin and the last one ends; ``resets``, where
positions start again at 0; and which part of which document every segment is.

Edge cases: a null or empty text is its end token alone. Repeated rows are
documents of their own, told apart by ``row``. A null id is kept. An empty table
gives no rows. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import text_of

#: Ids of a row.
ROW = 2048
#: UTF-8 bytes of text, which bound the number of tokens, that a group stands for.
GROUP_BYTES = 8 << 20
#: Characters after which a text is cut for the tokenizer, at the next place where
#: a token ends in any case.
CUT = 50_000

# Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SAFE = re.compile(r"(?<=\w) (?=\w)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE: base64 bytes and rank per line. The driver opens ``path``."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


class Tokenizer:
    """Byte-level BPE; the id after the last rank ends a document."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<i4")
        self._coder: tiktoken.Encoding | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coder": None}

    @property
    def coder(self) -> tiktoken.Encoding:
        if self._coder is None:
            self._coder = tiktoken.Encoding(
                "ranks", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={}
            )
        return self._coder

    def ids(self, text: str) -> np.ndarray:
        found: list[int] = []
        at = 0
        while at < len(text):
            cut = _SAFE.search(text, at + CUT) if len(text) - at > CUT else None
            end = cut.start() if cut else len(text)
            found += self.coder.encode_ordinary(text[at:end])
            at = end
        return np.array([*found, self.end], self.kind)

    def text(self, ids: np.ndarray) -> str:
        return self.coder.decode([i for i in ids.tolist() if i != self.end])


class FreeRows:
    """Rows by free capacity; a segment tree finds the least capacity that suffices."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, free: int) -> None:
        node = free + self.width
        self.some[node] = bool(self.rows[free])
        while node > 1:
            node >>= 1
            now = self.some[2 * node] or self.some[2 * node + 1]
            if self.some[node] == now:
                return
            self.some[node] = now

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        if len(self.rows[free]) == 1:
            self._mark(free)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least free capacity from ``least`` on, and that capacity."""
        node = least + self.width
        if not self.some[node]:
            # Up to the first ancestor with something to its right, then down its left edge.
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        free = node - self.width
        row = self.rows[free].pop()
        if not self.rows[free]:
            self._mark(free)
        return row, free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of places in ``lengths``, which fall and are at most ``capacity``."""
    free_rows = FreeRows(capacity)
    rows: list[list[int]] = []
    for place, length in enumerate(lengths):
        found = free_rows.take(length)
        if found is None:
            rows.append([place])
            row, free = len(rows) - 1, capacity
        else:
            row, free = found
            rows[row].append(place)
        if free > length:
            free_rows.put(row, free - length)
    return rows


_PARTS = "row long, doc_id long, part int, length int, ids binary"
_SEGMENT = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32())])
_PACKED = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>,"
    " segments array<struct<row:long,doc_id:long,part:int>>"
)


def parts_of(docs: DataFrame, tokenizer: Tokenizer, row: int) -> DataFrame:
    """Every document's ids in parts of at most ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "part", "length", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = []
                columns = [c.to_pylist() for c in batch.slice(at, 1000).columns]
                for number, doc_id, text in zip(*columns, strict=True):
                    ids = shared.value.ids(text)
                    for part, begin in enumerate(range(0, len(ids), row)):
                        held = ids[begin : begin + row]
                        out.append((number, doc_id, part, len(held), held.tobytes()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of(F.col("text")).alias("text"),
    )
    return numbered.mapInArrow(run, _PARTS)


def pack(docs: DataFrame, tokenizer: Tokenizer, row: int = ROW) -> DataFrame:
    """Packed rows of all documents."""
    total = docs.agg(F.sum(F.octet_length(text_of(F.col("text"))))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    kind, end = tokenizer.kind, tokenizer.end

    def packed(group: int, rows: pa.Table) -> pa.RecordBatch:
        columns = {c: rows.column(c).to_pylist() for c in ("row", "doc_id", "part", "length", "ids")}
        out: list[tuple] = []
        for k, places in enumerate(best_fit_decreasing(columns["length"], row)):
            ids = np.full(row, end, kind)
            joined = b"".join(columns["ids"][p] for p in places)
            bounds = np.cumsum([0, *[columns["length"][p] for p in places]]).astype(np.int32)
            ids[: bounds[-1]] = np.frombuffer(joined, kind)
            segments = [{c: columns[c][p] for c in ("row", "doc_id", "part")} for p in places]
            out.append(((group << 32) + k, int(bounds[-1]), ids.tobytes(), bounds, bounds[:-1], segments))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(_SEGMENT))
        names = ["pack_id", "n_tokens", "ids", "cu_seqlens", "resets", "segments"]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; one is held until the next begins."""
        held: list[pa.Table] = []
        current = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            group = rows.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and group[s] != current:
                    yield packed(int(current), pa.concat_tables(held))
                    held = []
                current = group[s]
                held.append(rows.slice(s, e - s))
        if held:
            yield packed(int(current), pa.concat_tables(held))

    group = F.pmod(F.xxhash64("row", "part"), F.lit(groups)).alias("group")
    parts = parts_of(docs, tokenizer, row).select(group, "*")
    arranged = parts.repartition(F.col("group")).sortWithinPartitions(
        "group", F.desc("length"), "row", "part"
    )
    return arranged.mapInArrow(run, _PACKED)


def position_ids(resets: list[int], n_tokens: int) -> np.ndarray:
    """The position of every token, starting at 0 in each segment."""
    places = np.arange(n_tokens)
    return places - np.repeat(np.array(resets), np.diff([*resets, n_tokens]))
