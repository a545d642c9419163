"""The corpus pipeline stage by stage and as a whole, against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm.common import stored
from tests.llm.helpers import EDGES, WORD, documents, sentence, with_clashes
from tests.llm.test_free import plain_set
from tests.llm.test_native import plain_targets

ITEM = "which large river flows along the northern border of that old country and then into the sea"
COMMON = "the of and to in is that it was for on are with as".split()


def prose(seed: int, n: int = 80) -> str:
    """Made-up words with common ones between them, no two texts alike."""
    draw = random.Random(seed)
    made = ("".join(draw.choices("abcdefghilmnoprstuv", k=draw.randint(4, 8))) for _ in range(n))
    return " ".join(f"{w} {draw.choice(COMMON)}" if k % 2 else w for k, w in enumerate(made))


def edited(text: str, seed: int) -> str:
    """The text with one word changed."""
    held = text.split()
    held[random.Random(seed).randrange(len(held))] = f"edited{'x' * (seed % 7)}"
    return " ".join(held)


GOOD = [(k, prose(k), "abc"[k % 3] if k % 10 else None) for k in range(60)]
COPIES = [(100 + k, edited(prose(k), k), "a") for k in range(12)] + [(200, prose(3).upper(), "b")]
REPEATED = [GOOD[5], GOOD[5], (5, prose(305), "c")]
LEAKED = [(300 + k, f"{prose(400 + k, 30)} {ITEM} {prose(500 + k, 30)}", "b") for k in range(6)]
JUNK = [(600 + k, "## $$ BUY NOW !! " * 40, "c") for k in range(20)] + [(700 + k, "too short", "c") for k in range(5)]
NOTHING = [(800, None, "a"), (801, "", None), (None, None, None), (None, prose(900), "a"), (None, prose(900), "a")]


def rows_of(df) -> Counter:
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def plain_distinct(given: Counter) -> Counter:
    """One row of each component of an exact join; rows without an id stay as they are."""
    held = sorted((r for r in given if r[0] is not None), key=lambda r: (r[0], r[1]))
    sets = [plain_set(t, 5) for _, t, _ in held]
    group = list(range(len(held)))
    for i, u in enumerate(sets):
        for j in range(i):
            v = sets[j]
            if 100 * len(u & v) >= 80 * len(u | v):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, row in zip(group, held, strict=True):
        first.setdefault(g, row)
    return Counter(first.values()) + Counter({r: n for r, n in given.items() if r[0] is None})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    given = GOOD + COPIES + REPEATED + LEAKED + JUNK + NOTHING
    with_clashes(documents(spark, given)).write.parquet(f"{at}/documents.parquet")
    items = [(1, ITEM), (2, None), (3, ""), (4, sentence(1, 12))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_equal_plain_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        after[name] = rows_of(docs)
    quality = Counter((*r,) for r in GOOD + COPIES + REPEATED + LEAKED + NOTHING[-2:])
    assert after["quality"] == quality
    distinct = plain_distinct(quality)
    assert sum(distinct.values()) == 60 + 1 + 6 + 2
    assert after["near_duplicates"] == distinct
    clean = distinct - Counter(LEAKED)
    assert after["decontamination"] == clean

    sizes = defaultdict(int)
    for (_, text, source), n in clean.items():
        sizes[source] += n * len(WORD.findall(text))
    taken, longest = defaultdict(int), defaultdict(int)
    for (doc, text, source), n in after["mixing"].items():
        words = len(WORD.findall(text))
        assert n <= 2 * clean[doc, text, source]
        taken[source] += n * words
        longest[source] = max(longest[source], words)
    assert set(after["mixing"]) <= set(clean)
    for source, target in plain_targets(dict(sizes)).items():
        assert int(target) <= taken[source] < target + longest[source]

    found = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == sum(
        (
            Counter({(doc, len(text.encode()) + 16, zlib.crc32(text.encode())): n})
            for (doc, text, _), n in after["mixing"].items()
        ),
        Counter(),
    )
    slots, shards = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add(r.shard)
        assert r.grown_shard in (r.shard, corpus_pipeline.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values()) and set(slots) <= set(range(corpus_pipeline.SHARDS))

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, found))


def test_edge_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    edges = with_clashes(documents(spark, EDGES))
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {d for d, _ in EDGES}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= kept and 1 in {r.doc_id for r in found}
    none = tmp_path / "none"
    edges.where(F.lit(False)).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0
