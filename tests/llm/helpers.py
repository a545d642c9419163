"""Small tables with the cases every operator has to bear."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(seed: int, n: int) -> str:
    """Distinct made-up words."""
    return " ".join(f"w{seed}x{k}" for k in range(n))


# Null ids, null and empty texts, repeated rows, ties, other white space, astral characters.
EDGES = [
    (1, "plain text of a few words, nothing more to it, and so on until it is long enough to keep"),
    (2, None),
    (3, ""),
    (4, " \n\t\v\f\r "),
    (5, "one"),
    (5, "one"),
    (6, "one"),
    (None, "a text without an id, which has some words, enough of them to be a text of its own"),
    (None, None),
    (7, "Ünïcödé 😀 text 😀 with no-break spaces"),
    (8, "long " * 30_000),
    (9, sentence(9, 20_000)),
]

# Columns named like what operators add or use inside.
CLASHING = ("row", "node", "uid", "shard", "slot", "bucket", "size", "kept", "record", "range", "n_words",
            "taken", "blob", "key", "group", "found", "spans", "_text", "_words", "probability", "copy")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})
