"""Quality by weak supervision: rules vote or abstain, and a label model weighs them.

Every rule looks at one property of a text and votes good (1) or bad (-1), or
abstains (0). How far a rule can be trusted is estimated from all documents
without labels: expectation-maximisation over the counts of vote patterns, of
which there are at most 3 to the number of rules, whatever the input's size. The
log-odds of the votes then add up to the probability that a text is good, and
that decides, not whether every single rule is passed.

Edge cases: a null or empty text has no words and fails the base. A null id is
kept as it is, repeated rows are rows of their own, an empty table gives no rows.
Input columns named like an added column are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import let, stored, text_of, without, words

#: Fixed values of the base.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

#: Rounds of expectation-maximisation; the estimates settle in under twenty.
ROUNDS = 25
#: The prior belief about a rule: imagined votes, as a share of all documents, and
#: the chances of a vote on a good and on a bad text. It says that rules are
#: better than chance, keeps a rule that hardly ever votes from being believed too
#: much, and weighs the same at every size of input.
PRIOR = 0.02
PRIOR_CHANCE = {1: (0.5, 0.2), 0: (0.48, 0.4), -1: (0.02, 0.4)}
#: Documents with at least this probability of being good are kept.
LEAST_PROBABILITY = 0.5

# Common short words of four languages, for the rule on function words.
COMMON_WORDS = (
    *("the", "of", "and", "to", "in", "that", "is", "with", "for"),
    *("der", "die", "und", "das", "ist", "ein", "mit", "von", "zu"),
    *("le", "la", "les", "des", "et", "que", "en", "pour", "une"),
    *("el", "los", "las", "de", "y", "por", "con", "una", "se"),
)
FEATURES = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_upper": "long",
    "n_letters": "long",
    "n_exclaims": "long",
    "n_common": "long",
}


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur more than once, from window hashes.

    Equal hashes meet by sorting; the starts of repeated windows, sorted again,
    cover the gap to the next start, but not more than a window.
    """

    def starts(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, k: x["h"].eqNullSafe(F.get(ordered, k - 1)["h"])
            | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]),
        )
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct(
                (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")
            ),
            lambda a: a["sum"],
        )

    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.array_sort(numbered), lambda ordered: let(starts(ordered), total))


def repeated_words(held: Column) -> Column:
    """Words in windows of five words found twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )

    def counted(h: Column) -> Column:
        alike = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(alike, _covered(h)).otherwise(F.lit(0))

    enough = F.size(held) > WINDOW
    return F.when(enough, let(windows(held), counted)).otherwise(F.lit(0))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts the base and the rules are about."""
    docs = without(docs, *FEATURES, "_text", "_words")
    text, held = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    computed = {
        "n_words": F.size(held),
        "word_chars": F.length(F.array_join(held, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))),
        "n_repeat_words": repeated_words(held),
        "n_lines": F.size(lines),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")),
        "n_exclaims": F.regexp_count(text, F.lit("!")),
        "n_common": F.size(
            F.array_intersect(F.transform(held, F.lower), F.array(*map(F.lit, COMMON_WORDS)))
        ),
    }
    prepared = docs.withColumn("_text", text_of(F.col("text")))
    prepared = prepared.withColumn("_words", words(text))
    return prepared.select(
        *docs.columns, *[computed[n].cast(kind).alias(n) for n, kind in FEATURES.items()]
    )


def base_failed() -> Column:
    """The base verdict, over the feature columns."""
    too_repetitive = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < LEAST_WORDS) | too_repetitive


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, over the feature columns: 1 good, -1 bad, 0 abstains.

    A rule votes only where its property says something; not being full of
    symbols, for one, makes no good text, so that rule never votes good.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = {c: F.col(c) / n for c in ("n_symbols", "n_repeat_words", "n_exclaims", "word_chars")}
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    letters = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    never = F.lit(False)
    return {
        "length": _vote(n.between(50, 100_000), F.col("n_words") < LEAST_WORDS),
        "repetition": _vote(never, share["n_repeat_words"] > 0.15),
        "symbols": _vote(never, share["n_symbols"] > 0.08),
        "capitals": _vote(never, upper > 0.4),
        "letters": _vote(letters > 0.93, letters < 0.6),
        "exclaims": _vote(never, share["n_exclaims"] > 0.2),
        "word_length": _vote(
            share["word_chars"].between(3, 9), (share["word_chars"] < 2) | (share["word_chars"] > 20)
        ),
        "lines": _vote(never, (F.col("n_lines") >= 3) & (dup > 0.5)),
        "common_words": _vote(F.col("n_common") >= 4, (n >= 30) & (F.col("n_common") == 0)),
    }


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class LabelModel:
    """What the votes are worth: the log-odds of the class and of every vote."""

    def __init__(self, base: float, worth: list[dict[int, float]]) -> None:
        self.base = base
        self.worth = worth

    @classmethod
    def fit(cls, patterns: Iterable[tuple[tuple[int, ...], int]], n_rules: int) -> LabelModel:
        """Estimate from (votes, number of documents), each pattern once.

        Starts from texts with a bad vote against those without. A rule has, for
        good and for bad texts, a chance of each vote and of abstaining.
        """
        patterns = sorted(patterns)
        every = sum(n for _, n in patterns)
        belief = [0.05 if min(v) < 0 else 0.95 for v, _ in patterns]
        model = cls(0.0, [dict.fromkeys((1, 0, -1), 0.0)] * n_rules)
        for _ in range(ROUNDS if every else 0):
            good = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
            worth = []
            for j in range(n_rules):
                counts = {vote: [PRIOR * every * p for p in PRIOR_CHANCE[vote]] for vote in (1, 0, -1)}
                for b, (v, n) in zip(belief, patterns, strict=True):
                    counts[v[j]][0] += b * n
                    counts[v[j]][1] += (1 - b) * n
                sums = [sum(c[y] for c in counts.values()) for y in (0, 1)]
                worth.append({k: math.log(c[0] / sums[0] / (c[1] / sums[1])) for k, c in counts.items()})
            model = cls(math.log((good + PRIOR * every) / (every - good + PRIOR * every)), worth)
            belief = [model.probability(v) for v, _ in patterns]
        return model

    def probability(self, votes: tuple[int, ...]) -> float:
        """That a text with these votes is good."""
        return _sigmoid(self.base + sum(w[v] for w, v in zip(self.worth, votes, strict=True)))

    def probability_column(self, votes: list[Column]) -> Column:
        """The same as an expression over vote columns."""
        odds = F.lit(self.base)
        for worth, vote in zip(self.worth, votes, strict=True):
            odds = odds + F.when(vote == 1, worth[1]).when(vote == -1, worth[-1]).otherwise(worth[0])
        return 1 / (1 + F.exp(-odds))


def fit(featured: DataFrame) -> LabelModel:
    """The label model of all documents, from the counts of vote patterns."""
    votes = rules()
    counts = featured.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count()
    patterns = [(tuple(row[k] for k in votes), row["count"]) for row in counts.collect()]
    return LabelModel.fit(patterns, len(votes))


def judged(featured: DataFrame) -> DataFrame:
    """Featured rows with base_failed, probability and kept."""
    model = fit(featured)
    judged_rows = featured.withColumn("base_failed", base_failed()).withColumn(
        "probability", model.probability_column(list(rules().values()))
    )
    kept = ~F.col("base_failed") & (F.col("probability") >= LEAST_PROBABILITY)
    return judged_rows.withColumn("kept", kept)


def quality_table(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    featured = with_features(docs.select("doc_id", "text")).drop("text")
    return judged(stored(featured, "quality-features")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "probability",
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as they were."""
    record = docs.select(F.struct(*docs.columns).alias("record"), "text")
    featured = stored(with_features(record).drop("text"), "quality-documents")
    return judged(featured).where("kept").select("record.*")
