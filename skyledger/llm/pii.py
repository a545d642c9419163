"""Personal data by bootstrapped contextual extraction.

Formats that can be checked (email, ip, card, phone) give the seeds. What stands
around a seed gives lexical patterns of several widths: two words before, one
before and one after, one before with the shape of the value's digits, and a
label such as ``tel:`` alone. Patterns and the values they surround form a graph
that Spark scores in rounds: a pattern is trusted if nearly all of its values are
believed, and a value is believed if it is a seed or a trusted pattern surrounds
it. Both only grow, so the rounds end when no pattern is added. A trusted pattern
marks identifiers whose own format says nothing: numbered ones anywhere, words
without digits only after a label, where all values are in the graph and so count
against the pattern.

Finding formats and contexts is per text and runs in Arrow batches; everything
over the corpus (edges, scores, the join back) is DataFrame work. Edges are
distinct pairs, aggregated before they are shuffled, so a value or a pattern
that a third of the rows hold is one edge per task.

Edge cases: a null or empty text has no spans. Repeated rows are rows of their
own, null ids stay, an empty table gives no rows. Patterns need several distinct
values, so copies of one text are no evidence. Columns but doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored

#: The base kinds in order.
KINDS = ("email", "ip", "card", "phone")

#: Distinct believed values a pattern needs, and doubt added to every pattern as
#: so many values that are not believed.
LEAST_VALUES = 3
DOUBT = 0.5
#: Share of believed values from which a pattern is trusted, and from which it is
#: trusted with words that have few digits.
MARKS, STRONG = 0.8, 0.9
#: An identifier without a known format: at least so many characters and digits;
#: after a label any value of two characters.
LEAST_CHARACTERS, LEAST_DIGITS, LEAST_LABELLED = 6, 4, 2
#: Words longer than this stand in patterns by their digest.
LONG_WORD = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERED = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_LABELLED = re.compile(r"""(?<![\w-])[^\W\d_][\w-]*+["']?[:=#]["']?\s?(\S++)""")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SHAPES = ((re.compile(r"[0-9]"), "9"), (re.compile(r"[^\W\d_]+"), "a"))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ with a domain, back over what may stand before it."""
    free = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        for m in _IP.finditer(text, run.start(), run.end()):
            parts = (p.lstrip("0") for p in m.group().split("."))
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) by begin, then kind as listed; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(b, 0, e) for b, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(b, 1, e) for b, e in _ips(text)]
        found += [(b, 2, e) for b, e in _cards(text)]
        if "+" in text:
            found += [(b, 3, e) for b, e in _phones(text)]
    return [(b, e, KINDS[k]) for b, k, e in sorted(found)]


def _short(word: str) -> str:
    return word if len(word) <= LONG_WORD else hashlib.sha1(word.encode("utf-8", "replace")).hexdigest()


def _word(token: str) -> str:
    """A token as patterns name it: lower case, bare, a label with its colon."""
    bare = _EDGES.sub("", token.lower())
    return _short(bare) + ":" * bool(bare and token.rstrip("\"'(")[-1:] in (":", "=", "#"))


def shape_of(value: str) -> str:
    """Digits as 9, letters of a stretch as one a, the rest as it is."""
    for what, sign in _SHAPES:
        value = what.sub(sign, value)
    return _short(value)


class _Contexts:
    """The patterns around places of a text, asked for from left to right."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [b for b, _ in self.tokens]
        self.done = 0

    def _token(self, k: int) -> str:
        return _word(self.text[slice(*self.tokens[k])]) if 0 <= k < len(self.tokens) else ""

    def patterns(self, begin: int, end: int) -> list[str]:
        at = bisect_right(self.starts, begin) - 1
        glued = _word(self.text[max(self.starts[at], min(self.done, begin)) : begin])
        self.done = max(self.done, end)
        before, earlier = (glued, self._token(at - 1)) if glued else (self._token(at - 1), self._token(at - 2))
        after = self._token(bisect_left(self.starts, end))
        if not before:
            return []
        found = [f"{before} _ {shape_of(self.text[begin:end])}"]
        if earlier:
            found.append(f"{earlier} {before} _")
        if after:
            found.append(f"{before} _ {after}")
        if before.endswith(":"):
            found.append(f"{before} _")
        return sorted(set(found))


def _unknown(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of values without a format, by begin, outside the places taken."""
    after_label = [m.span(1) for m in _LABELLED.finditer(text)]
    numbered = [m.span() for m in _NUMBERED.finditer(text)] if _DIGIT.search(text) else []
    found = []
    for places, labelled in ((after_label, True), (numbered, False)):
        at, held = 0, sorted(taken + found)
        for begin, end in places:
            while at < len(held) and held[at][1] <= begin:
                at += 1
            if at < len(held) and held[at][0] < end:
                continue
            while begin < end and not text[begin].isalnum():
                begin += 1
            while end > begin and not text[end - 1].isalnum():
                end -= 1
            if end - begin >= LEAST_LABELLED and (labelled or _is_numbered(text[begin:end])):
                found.append((begin, end))
    return sorted(found)


def _is_numbered(value: str) -> bool:
    return len(value) >= LEAST_CHARACTERS and sum(map(str.isdigit, value)) >= LEAST_DIGITS


def occurrences(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Seeds and values without a format, with the patterns around them."""
    places = [(b, e, kind) for b, e, kind in base]
    places += [(b, e, None) for b, e in _unknown(text, [(b, e) for b, e, _ in base])]
    if not places:
        return []
    around = _Contexts(text)
    return [
        {
            "begins": b,
            "ends": e,
            "kind": k,
            "value": text[b:e],
            "plain": k is None and not _is_numbered(text[b:e]),
            "patterns": around.patterns(b, e),
        }
        for b, e, k in sorted(places, key=lambda p: p[:2])
    ]


_MARK = "struct<begins:long,ends:long,kind:string,value:string,plain:boolean,patterns:array<string>>"
_SCANNED = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long,"
    f" base_sha256 string, base array<string>, marks array<{_MARK}>"
)
_MARK_ARROW = pa.struct(
    [
        ("begins", pa.int64()),
        ("ends", pa.int64()),
        ("kind", pa.string()),
        ("value", pa.string()),
        ("plain", pa.bool_()),
        ("patterns", pa.list_(pa.string())),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans, marks = [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            for kind in KINDS:
                counts[kind].append(sum(k == kind for _, _, k in found))
            spans.append([f"{k}:{b}:{e}" for b, e, k in found])
            digests.append(hashlib.sha256(",".join(spans[-1]).encode()).hexdigest())
            marks.append(occurrences(text or "", found))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                *[pa.array(counts[k], pa.int64()) for k in KINDS],
                pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(pa.string())),
                pa.array(marks, pa.list_(_MARK_ARROW)),
            ],
            names=["row", "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "marks"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per text: base spans, and every mark with its patterns."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return numbered.mapInArrow(_scan, _SCANNED)


def edges_of(scanned: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind, plain); kind is null where the format is unknown."""
    marks = scanned.select(F.explode("marks").alias("m"))
    return marks.select(
        F.explode("m.patterns").alias("pattern"), "m.value", "m.kind", "m.plain"
    ).distinct()


def _reach(patterns: DataFrame, places: DataFrame) -> DataFrame:
    """Places with the patterns trusted enough for what stands there."""
    return places.join(patterns, "pattern").where(~F.col("plain") | (F.col("belief") >= STRONG))


def score_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, belief) of all trusted patterns.

    In each round belief is the share of believed values, with doubt; it is
    that of the round that added the last pattern.
    """
    edges = stored(edges, "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    unknown = edges.where("kind is null").select("pattern", "value", "plain")
    # A pattern too small for the doubt or without a seed on the way is never trusted.
    pairs = stored(
        edges.join(sizes.where(F.col("n") >= LEAST_VALUES), "pattern")
        .select("pattern", "value", "n")
        .distinct(),
        "pii-pairs",
    )
    values, known = seeds, -1
    while True:
        support = pairs.join(values, "value").groupBy("pattern", "kind", "n").agg(F.count("*").alias("held"))
        belief = F.col("held") / (F.col("n") + DOUBT)
        trusted = support.where((F.col("held") >= LEAST_VALUES) & (belief >= MARKS))
        patterns = stored(trusted.select("pattern", "kind", belief.alias("belief")), "pii-patterns")
        learned = _reach(patterns, unknown).select("value", "kind")
        values = stored(seeds.union(learned).distinct(), "pii-values")
        believed = values.count()
        if believed == known:
            return patterns
        known = believed


def discover(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row, found): spans of identifiers that a trusted pattern surrounds."""
    places = scanned.select("row", F.explode("marks").alias("m")).where("m.kind is null")
    around = places.select(
        "row", "m.begins", "m.ends", "m.plain", F.explode("m.patterns").alias("pattern")
    )
    hits = _reach(patterns, around)
    best = hits.groupBy("row", "begins", "ends").agg(
        F.min(F.struct((-F.col("belief")).alias("minus"), "kind")).alias("best")
    )
    span = F.concat_ws(
        ":", F.concat(F.lit("like_"), "best.kind"), F.col("begins").cast("string"), F.col("ends").cast("string")
    )
    return best.groupBy("row").agg(F.collect_list(span).alias("found"))


def _by_begin(spans):
    """Spans of all kinds, joined: by begin, base kinds as listed first."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def parts(s):
        kind = F.split_part(s, F.lit(":"), F.lit(1))
        begin = F.split_part(s, F.lit(":"), F.lit(2)).cast("long")
        return F.struct(begin, F.coalesce(F.try_element_at(order, kind), F.lit(len(KINDS))), kind, s.alias("s"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, parts)), lambda p: p["s"]), ",")


def pii_table(docs: DataFrame) -> DataFrame:
    """Base counts and digest of every document, and all spans."""
    scanned = stored(scan(docs), "pii-scan")
    found = discover(scanned, score_patterns(edges_of(scanned)))
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    return scanned.drop("marks").join(found, "row", "left").select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        "base_sha256",
        _by_begin(every).alias("spans"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"),
    )
