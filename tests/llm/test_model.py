"""Hard negatives, periodic runs and language-model scores against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import language, negatives, periodic
from tests.llm.helpers import EDGES, documents, sentence, with_clashes


@pytest.fixture(scope="module")
def edges(spark):
    return with_clashes(documents(spark, EDGES)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- hard negatives ---------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, positives=5, negatives=10):
    held = []
    for number, vector, label in rows:
        bad = vector is None or any(x is None or not math.isfinite(x) for x in vector)
        if number is None or label is None or bad:
            continue
        label = (label + 1) % 10 if number % 7 == 0 else label
        held.append((number, label, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    out = Counter()
    for k, a in enumerate(held):
        if a[0] % 100:
            continue
        others = sorted(((-score(a, b), b[0], b[1]) for i, b in enumerate(held) if i != k))
        for p, positive, _ in [x for x in others if x[2] == a[1]][:positives]:
            fits = [x for x in others if x[2] != a[1] and 30 * -p <= 100 * -x[0] <= 90 * -p]
            for rank, (n, negative, _) in enumerate(fits[:negatives], 1):
                out[a[0], positive, rank, negative, -p, -n] += 1
    return out


def found_negatives(spark, rows):
    given = spark.createDataFrame(rows, VECTORS)
    return Counter(map(tuple, negatives.hard_negatives(negatives.embedding_rows(given)).collect()))


@pytest.mark.parametrize("m,n,k,leaf", [(1, 1, 1, 1), (5, 7, 3, 1), (33, 65, 40, 4), (130, 67, 64, 16), (2, 90, 0, 2)])
def test_strassen_is_the_product(m, n, k, leaf):
    draw = np.random.default_rng(m)
    a, b = draw.integers(-(2**20), 2**20, (m, k)), draw.integers(-(2**20), 2**20, (n, k))
    assert (negatives.strassen(a, b, leaf) == a @ b.T).all()


def test_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ROWS", 37)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 4)  # several blocks and passes
    monkeypatch.setattr(negatives, "LEAF", 2)
    draw = random.Random(5)
    # Few values make many ties; ids of both signs and of any size.
    rows = [
        (draw.choice([1, -1, 10**12 + 1]) * k, [draw.choice([-0.25, 0.0, 0.25, 0.5]) for _ in range(5)], draw.randrange(4))
        for k in range(900)
    ]
    assert found_negatives(spark, rows) == plain_negatives(rows)


def test_negatives_on_edges(spark):
    rows = [
        (0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 2), (1, [0.5, 0.4], 2), (2, [0.5, 0.3], 3),
        (3, [0.2, 0.2], 9), (100, [0.5, -0.5, 0.25], 3), (200, [], 3), (300, [0.1, None], 3), (400, [float("nan")], 1),
        (500, [float("inf"), 1.0], 1), (600, None, 1), (700, [0.1, 0.2], None), (None, [0.3, 0.3], 2), (800, [-0.5, 0.5], 4),
    ]
    assert found_negatives(spark, rows) == plain_negatives(rows)
    assert found_negatives(spark, []) == Counter()
    assert found_negatives(spark, rows[2:6]) == Counter()  # no anchor
    with pytest.raises(ValueError):
        found_negatives(spark, [(0, [1e20], 1), (1, [1e20], 2)])


def test_negatives_take_other_columns_and_labels(spark):
    rows = spark.createDataFrame(
        [(100, "cat", [3, 4], True, "x"), (2, "cat", [3, 3], False, "x"), (3, "dog", [2, 2], None, "x"), (4, "dog", [0, 0], False, "x")],
        "id long, label string, vector array<long>, anchor boolean, rank string",
    )
    assert [tuple(r) for r in negatives.hard_negatives(rows).collect()] == [(100, 2, 1, 3, 21, 14)]


# --- periodic runs ----------------------------------------------------------


def plain_runs(held, least_length=6, least_power=4):
    n, out = len(held), []
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            if held[i] != held[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and held[j] == held[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(held[x] == held[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least_length, least_power * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_periodic(draw):
    held = []
    for _ in range(draw.randint(0, 7)):
        unit = [draw.choice("ab" if draw.random() < 0.7 else "abcd") for _ in range(draw.randint(1, 5))]
        part = (unit * draw.randint(1, 8))[: draw.randint(1, 30)]
        held += part * draw.choice([1, 1, 4])
    return held


@pytest.mark.parametrize("least", [(6, 4), (3, 3), (2, 5)])
def test_runs_are_all_runs(least):
    draw = random.Random(sum(least))
    count = 0
    for _ in range(400):
        texts = [[w.encode() for w in random_periodic(draw)] for _ in range(draw.randint(1, 5))]
        want = [plain_runs(t, *least) for t in texts]
        assert periodic.runs_of(texts, *least) == want
        count += sum(map(len, want))
    assert count > 500


def test_runs_of_one_word_and_of_nothing():
    assert periodic.runs_of([[b"x"] * 50_000, [], [b"x"] * 5, [b"x"] * 6], 6, 4) == [[(0, 50_000, 1)], [], [], [(0, 6, 1)]]
    assert periodic.runs_of([], 6, 4) == []


def test_suffix_order_and_prefixes():
    held = [w.encode() for w in "a b a b a b c a b a b".split()]
    ids = np.array([-1, *[ord(w) for w in held], -2])
    places, lcp = periodic.suffix_classes(ids, np.array([-1, *[0] * (len(held) + 1)]), 2)
    for k in range(1, len(places)):
        a, b = held[places[k - 1] - 1 :], held[places[k] - 1 :]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (common if common >= 2 else 0)


def plain_run_row(number, text):
    held = (text or "").encode().split()
    h = 1 if number is None else zlib.crc32(str(number).encode())
    g, n = h // 10, len(held)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        held = [held[i] if i < a else held[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(held)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    left = b" ".join(w for k, w in enumerate(held) if k not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (number, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_run_table_against_plain_rows(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(random_periodic(draw) + sentence(k, draw.randint(0, 40)).split())) for k in range(400)]
    rows += [(k, " ".join(random_periodic(draw))) for k in range(400, 600)] + [(3, "a\tb a\nb a b a b"), (3, "a b " * 4)]
    got = Counter(map(tuple, periodic.run_table(documents(spark, rows)).collect()))
    assert got == Counter(plain_run_row(*r) for r in rows)
    made = [k for k in range(600) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(made) > 30


def test_run_table_on_edges(spark, edges, empty):
    got = Counter(map(tuple, periodic.run_table(edges).collect()))
    want = [plain_run_row(r[0], r[1]) for r in EDGES if r[0] != 8]
    text = EDGES[10][1]
    assert EDGES[10][0] == 8 and len(text.split()) == 30_000
    one = hashlib.sha256(b"long").hexdigest()
    want.append((8, 1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), one))
    assert got == Counter(want)
    assert periodic.run_table(empty).count() == 0


def test_runs_keep_columns_and_collapse(spark, monkeypatch):
    monkeypatch.setattr(periodic, "GROUP_WORDS", 3)
    given = spark.createDataFrame([("r", 1, "x y x y x y x y z", "c"), ("s", 2, None, None)], "runs string, n int, text string, extra string")
    rows = {r.n: r for r in periodic.periodic_runs(given).collect()}
    assert rows[1].collapsed == "x y z" and [tuple(r) for r in rows[1].runs] == [(0, 8, 2)] and rows[1].extra == "c"
    assert rows[2].collapsed == "" and rows[2].runs == []


# --- language model ---------------------------------------------------------


def plain_base(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) of each row."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    held_out = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held_out) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (
            d, h, len(t), sum(counts[w] > 0 for w in t), n,
            sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
        )
        for (d, _), h, t in zip(rows, held_out, tokens)
    ]


def chain(seed, n):
    """Words of which each mostly decides the next."""
    draw, at, out = random.Random(seed), 0, []
    for _ in range(n):
        out.append(f"S{at}")
        at = (at * 7 + 3) % 40 if draw.random() < 0.9 else draw.randrange(40)
    return " ".join(out)


def same_base(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5], round(r[5], 4))
    got = sorted((tuple(r[:6]) for r in got), key=key)
    for mine, want in zip(got, sorted(plain_base(rows), key=key), strict=True):
        assert mine[:5] == want[:5] and mine[5] == pytest.approx(want[5], abs=1e-6)


def test_language_model_on_a_chain(spark, monkeypatch):
    monkeypatch.setattr(language, "HEAD", 60)  # some words are frequent, others meet their counts in the join
    monkeypatch.setattr(language, "TRAIN_TOKENS", 5_000)
    rows = [(k, chain(k, 120) + " rare%d Common" % (k % 50) + (" x" * 100).replace(" ", "") * (k % 3)) for k in range(600)]
    got = language.score_table(documents(spark, rows)).collect()
    same_base(got, rows)
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    tokens = sum(r.n_tokens for r in held)
    # Knowing the word before is worth more than a factor of two a token.
    assert sum(r.score - r.base_score for r in held) / tokens > math.log10(2)


def test_probabilities_sum_to_one(spark, monkeypatch):
    docs = documents(spark, [(k, chain(k, 50) + f" r{k}") for k in range(80)]).withColumn("tenth", language.remainder(F.col("doc_id")))
    counts = language.count_tokens(docs.where("tenth > 0")).cache()
    known = language.vocabulary(counts, shortlist=20)
    network = language.train(docs, known, "tenth")
    assert known.size == 20 and network.size == 20
    first, second = np.divmod(np.arange(22 * 22), 22)
    total = sum(np.exp(network.log_probabilities(first, second, np.full(len(first), w))) for w in range(21))
    assert np.allclose(total, 1, atol=1e-4)
    listed = set(list(known.head)[:20])
    others = [c for k, c in counts.collect() if k.encode() not in listed]
    assert sum(c + 0.1 for c in others) + 0.1 == pytest.approx(known.rest)


def test_language_model_on_edges(spark, edges, empty):
    rows = [(d, t) for d, t, *_ in EDGES]
    got = language.score_table(edges).collect()
    same_base(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)
    assert language.score_table(empty).count() == 0
    alone = language.score_table(documents(spark, [(None, "held out words")])).collect()
    assert [tuple(r) for r in alone] == [(None, True, 4, 0, 0, 0.0, 0.0)]


def test_rows_keep_their_columns(spark):
    docs = documents(spark, [(k, chain(k, 20)) for k in range(30)]).withColumn("tail", F.lit("x")).withColumn("tenth", F.lit(1))
    counts = language.count_tokens(docs).cache()
    known = language.vocabulary(counts)
    scored = language.score(docs, known, counts, language.train(docs, known, "tenth"))
    assert scored.columns == ["doc_id", "lang", "source", "n_chars", "tenth", "n_tokens", "n_known", "base_score", "score"]
    assert scored.count() == 30


def test_full_tables_of_counts_are_given_on(spark, monkeypatch):
    rows = [(k, f"w{k % 7} W{k % 7}\x0b" + "x" * (60 + k % 9) + "\u00c9 \u00a0") for k in range(90)]
    docs = documents(spark, rows).coalesce(1)
    monkeypatch.setattr(language, "COUNTED", 5)
    words = Counter(language.key_of(w) for _, t in rows for w in [*t.encode().lower().split(), b""])
    counts = language.count_tokens(docs)
    assert {r.key.encode(): r.c for r in counts.collect()} == words
    # Words reach Spark counted, not one row each.
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_a_step_moves_only_rows_that_occur():
    draw = np.random.default_rng(1)
    shares = np.full(301, 1 / 301)
    training = language.Training(language.Network.start(shares, 8), shares, 3)
    start = language.Training(language.Network.start(shares, 8), shares, 3).net
    first, second, target = draw.integers(0, 9, (3, 200))
    held, sums = training._sums(first, np.ones((200, 1), np.float32))
    assert held.tolist() == sorted(set(first.tolist()))
    assert sums[:, 0].tolist() == [Counter(first.tolist())[w] for w in held.tolist()]
    training.step(first, second, target)
    net = training.net
    assert (net.before[:, :9] != start.before[:, :9]).any(axis=2).all()
    assert (net.before[:, 9:] == start.before[:, 9:]).all()
    moved = np.flatnonzero((net.after != start.after).any(axis=1))
    assert set(range(9)) <= set(moved.tolist()) and len(moved) <= 9 + language.NOISE
    assert (np.flatnonzero(net.bias != start.bias) == moved).all()


def test_tokens_are_counted_without_functions_on_arrays(spark):
    docs = spark.createDataFrame([("a  B\tb", ), (None,), (" ",), ("x" * 70,)], "text string")
    counts = language.count_tokens(docs)
    assert "lambda" not in counts._jdf.queryExecution().executedPlan().toString()
    long = language.key_of(b"x" * 70).decode()
    assert {(r.key, r.c) for r in counts.collect()} == {("a", 1), ("b", 2), ("", 4), (long, 1)}


def test_text_of_a_block_is_worked_out_once(monkeypatch):
    from skyledger.llm import blocks, labeller

    calls = []
    monkeypatch.setattr(blocks, "unescape", lambda text: calls.append(text) or text)
    found = blocks.parse("<p>one</p><p>two</p>")
    labeller.vectors(found)
    assert [b.text for b in found] == calls == ["one", "two"]
