"""Secret scan over an incremental ledger of blobs.

A text is content-addressed: its blob name is the SHA-256 of its bytes. However
many paths or versions hold a blob, it is scanned once for each version of each
rule; the ledger keeps which (blob, rule version) pairs were scanned, and the
findings. A later scan reads only pairs the ledger has not seen, and findings
are joined back to every path that ever held the blob.

Everything is a DataFrame expression. Spark finds matches but not positions;
these follow from splitting the text by the same pattern: pieces and matches
alternate, so the running sum of their lengths gives every start.

Edge cases: a null text is the empty blob. Repeated paths are versions of their
own and get the findings each. A null path is kept. Empty tables give no rows.
Only the path and text columns of the input are used, others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import shared_path, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``group`` is the part of the match that needs ``least`` characters; shorter
    ones are dropped, and the text they cover is not searched again. Matching
    starts anew only after a match, so patterns must not depend on a length
    that ``least`` states. ``hint`` is a cheap pattern that every match has.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values, in the order of kinds: the three base rules.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", least=24),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule(
        "private_key",
        2,
        r"-----BEGIN (?:[A-Z0-9 ]* )?PRIVATE KEY-----",
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY",
    ),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule(
        "jwt",
        1,
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++",
        r"eyJ[A-Za-z0-9_-]",
        least=40,
    ),
    Rule("slack", 1, r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule(
        "url_login",
        2,
        r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]{3,}+@",
        r"://[^\s:/@]+:",
    ),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(text_of(text).cast("binary"), 256)


def _matches(text: Column, rule: Rule, wanted: Column) -> Column:
    """Array of (piece before, match, tested part), empty where unwanted."""
    every = F.arrays_zip(
        F.slice(
            F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)),
            1,
            F.size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))),
        ).alias("gap"),
        F.transform(
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m)
        ).alias("width"),
        F.transform(
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)),
            lambda m: F.length(m),
        ).alias("tested"),
    )
    return F.when(wanted & text.rlike(rule.hint), every).otherwise(F.array())


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, version, begins, ends) for every finding in (blob, text, todo).

    ``todo`` names the rules to apply. Positions count code points.
    """
    text = F.col("text")
    per_rule = [
        F.struct(
            F.lit(r.kind).alias("kind"),
            F.lit(r.version).alias("version"),
            F.lit(r.least).alias("least"),
            _matches(text, r, F.array_contains("todo", r.name)).alias("matches"),
        )
        for r in rules
    ]
    found = blobs.select("blob", F.explode(F.array(*per_rule)).alias("of")).where(
        F.size("of.matches") > 0
    )
    matches = found.select(
        "blob", "of.kind", "of.version", "of.least", F.posexplode("of.matches").alias("n", "m")
    )
    so_far = (
        Window.partitionBy("blob", "kind")
        .orderBy("n")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = F.sum(F.col("m.gap") + F.col("m.width")).over(so_far)
    return (
        matches.withColumn("ends", ends.cast("long"))
        .where(F.col("m.tested") >= F.col("least"))
        .select("blob", "kind", "version", (F.col("ends") - F.col("m.width")).alias("begins"), "ends")
    )


class Ledger:
    """Tables of scanned pairs and findings under one path all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def scanned(self) -> DataFrame:
        """(blob, rule) pairs that were scanned."""
        return self._read("scanned", "blob string, rules array<string>").select(
            "blob", F.explode("rules").alias("rule")
        )

    def findings(self) -> DataFrame:
        """Findings of all scans; one written twice by a repeated scan counts once."""
        kept = "blob string, kind string, version int, begins long, ends long"
        return self._read("findings", kept).distinct()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, text, todo): each blob with rules it was not scanned for.

        A text is kept once per blob already on the map side, so a blob that a
        third of the rows hold is a few rows when it is shuffled.
        """
        blobs = versions.select("blob", "text").dropDuplicates(["blob"])
        known = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("known"))
        names = F.array(*[F.lit(r.name) for r in rules])
        todo = F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))
        return (
            blobs.join(known, "blob", "left")
            .select("blob", "text", todo.alias("todo"))
            .where(F.size("todo") > 0)
        )

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen of (blob, text) rows.

        Findings are written before the pairs are marked, so a scan that was
        broken off is done again and never skipped.
        """
        unseen = self.unseen(versions, rules)
        find(unseen, rules).write.mode("append").parquet(f"{self.path}/findings")
        names = F.array(*[F.lit(r.name) for r in rules])
        held = versions.select("blob").distinct()
        known = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("known"))
        fresh = F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))
        (
            held.join(known, "blob", "left")
            .select("blob", fresh.alias("rules"))
            .where(F.size("rules") > 0)
            .write.mode("append")
            .parquet(f"{self.path}/scanned")
        )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["span"]), ",")


def digests(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob: counts of the base kinds, their digest, and all spans."""
    order = F.element_at(
        F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind")
    )
    span = F.concat_ws(":", "kind", F.col("begins").cast("string"), F.col("ends").cast("string"))
    spans = F.array_sort(
        F.collect_list(F.struct("begins", order.alias("place"), span.alias("span"), "kind"))
    )
    base_kinds = [r.kind for r in BASE_RULES]
    gathered = findings.groupBy("blob").agg(
        spans.alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base_kinds]
    )
    base = F.filter("all", lambda s: s["kind"].isin(base_kinds))
    return gathered.select(
        "blob",
        *[F.col(f"n_{k}") for k in base_kinds],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """One row per document with what its blob holds, after scanning the unseen."""
    versions = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    versions = versions.withColumn("blob", blob_of(F.col("text")))
    ledger.scan(versions)
    current = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in RULES]
    findings = ledger.findings().where(F.array_contains(F.array(*current), F.struct("kind", "version")))
    found = versions.select("doc_id", "blob").join(digests(findings), "blob", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select(
        "doc_id",
        *counts,
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        "blob",
    )


def scan_table(docs: DataFrame) -> DataFrame:
    """The scan of all documents under a ledger of its own."""
    spark = docs.sparkSession
    return scan_documents(docs, Ledger(spark, shared_path(spark, "secret-ledger")))
