"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger holds rows of a blob's address, the rule versions it
was scanned with and the spans found, each with the version of the rule that found it.  A scan looks for
addresses with a rule version that the ledger lacks, fetches the texts of these alone, scans only the
missing pairs, and joins the findings back to all paths.  Findings of a rule's superseded versions stay in the
ledger and are not reported.  :func:`append` keeps the new rows in a table of the
caller's, from which :func:`open_ledger` reads them again in a later run.

A rule is a regular expression whose matches are taken leftmost and without
overlap; matches whose measured group is too short are dropped afterwards.
Offsets are code points, the end exclusive.

Defined results: a null text is the empty blob.  Empty texts have no spans.
Repeated rows and copies share one blob and each get its findings.  No rows: no
findings.  Long texts are scanned whole; a regular expression is anchored at the
end of the match before it, so the time grows with the length.  Extra columns
are carried to the result of :func:`scan` when named in ``path``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import checked_broadcast, drop, materialize

LEDGER = "blob binary, scanned array<string>, spans array<struct<version:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` with ``group`` (0: the match) of at least ``least`` characters.

    ``hint`` is an expression that every text with a kept match satisfies.
    """

    name: str
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def version(self) -> str:
        return f"{self.name}@{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"


# Fixed patterns.
_KEYWORD = r"((?i:password|passwd|secret|token|api_?key))"
_ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
#: A run that is long enough is found at its beginning or not at all, so the
#: bounds of these two stand in the pattern; an assignment that is too short
#: still uses up its text, so there the bound is applied to its matches.
RULES = (
    Rule("assign", _ASSIGN + "+)", 2, 12, _ASSIGN + "{12})"),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _lengths(text: Column, rule: Rule) -> Column:
    """Per match: lengths of the gap before it, of the match, and of the measured group."""
    anchored = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    part = lambda group: F.transform(F.regexp_extract_all(text, anchored, F.lit(group)), F.char_length)
    found = F.transform(
        F.arrays_zip(part(1).alias("gap"), part(2).alias("match"), part(2 + rule.group).alias("measured")),
        lambda x: F.struct(F.lit(rule.name).alias("rule"), x["gap"].cast("long").alias("gap"), x["match"].cast("long").alias("match"), x["measured"].cast("long").alias("measured")),
    )
    return F.when(text.rlike(rule.hint), found)


def _scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob``, ``rule``, ``start``, ``end`` of the kept matches of (blob, text, todo)."""
    none = F.array().cast("array<struct<rule:string,gap:bigint,match:bigint,measured:bigint>>")
    parts = [F.coalesce(F.when(F.array_contains("todo", r.version), _lengths(F.col("text"), r)), none) for r in rules]
    matches = blobs.select("blob", F.posexplode(F.concat(*parts)).alias("at", "m")).select("blob", "at", "m.*")
    before = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("gap") + F.col("match")).over(before)
    least = F.coalesce(*[F.when(F.col("rule") == r.name, r.least) for r in rules])
    return matches.withColumn("end", end).where(F.col("measured") >= least).select("blob", "rule", (F.col("end") - F.col("match")).alias("start"), "end")


def _unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """``blob, text, todo``: distinct blobs with the rule versions they were not scanned with."""
    every = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(_blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        pending = blobs.withColumn("todo", every)
    else:
        # addresses alone tell what is missing
        known = ledger.select("blob", F.explode("scanned").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
        missing = blobs.select("blob").distinct().join(known, "blob", "left")
        missing = missing.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        pending = blobs.join(checked_broadcast(materialize(missing, "missing-pairs")), "blob")
    return pending.select("blob", "text", "todo").dropDuplicates(["blob"])


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows to append to the ledger for the texts of ``versions``.

    A row has ``blob``, ``scanned`` (rule versions) and ``spans`` (version of the rule, start, end;
    null if there are none).  They are written to the shared folder once.
    """
    distinct = materialize(_unseen(versions, ledger, rules), "unseen-blobs")
    version = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.version)) for r in rules])
    spans = _scan(distinct, rules).groupBy("blob").agg(F.collect_list(F.struct(version.alias("version"), "start", "end")).alias("spans"))
    scanned = distinct.select("blob", F.col("todo").alias("scanned"))
    added = materialize(scanned.join(spans, "blob", "left").to(versions.sparkSession.createDataFrame([], LEDGER).schema), "blob-ledger")
    drop(distinct)
    return added


def append(added: DataFrame, path: str) -> None:
    """Add rows of :func:`update_ledger` to the ledger kept at ``path``; repeated rows change nothing."""
    added.write.mode("append").parquet(path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``, or None before the first :func:`append`."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(versions: DataFrame, path: Sequence[str], ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` and the ledger that now covers them.

    The findings have a struct ``path`` of the ``path`` columns and ``spans``, an array of
    (start, order, end, rule) by start, then order of the rule; empty if there are none.
    """
    added = update_ledger(versions, ledger, rules)
    whole = added if ledger is None else ledger.unionByName(added)
    by_version = lambda value: F.coalesce(*[F.when(F.col("s.version") == r.version, F.lit(value(i, r))) for i, r in enumerate(rules)])
    current = [r.version for r in rules]
    found = (
        whole.where(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("s"))
        .where(F.col("s.version").isin(current))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("s.start"), by_version(lambda i, r: i).alias("order"), F.col("s.end"), by_version(lambda i, r: r.name).alias("rule")))).alias("spans"))
    )
    found = materialize(found, "findings")
    paths = versions.select(F.struct(*path).alias("path"), _blob(F.col("text")).alias("blob"))
    joined = paths.join(found, "blob", "left")
    empty = F.array().cast(found.schema["spans"].dataType)
    return joined.select("path", F.coalesce("spans", empty).alias("spans")), whole


def digest(findings: DataFrame) -> DataFrame:
    """Counts per rule, the base spans' SHA-256 and all spans, per document."""
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda rule: F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    return findings.select("path.doc_id", n("assign"), n("access"), n("hex"), F.sha2(written.cast("binary"), 256).alias("base_sha256"), written.alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    findings, _ = scan(docs, ["doc_id"])
    return digest(findings)
