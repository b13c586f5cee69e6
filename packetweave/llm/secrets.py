"""Secret scans over every historical version, by an incremental blob ledger.

Each version of each path is addressed by the SHA-256 of its text.  The ledger
holds one row per blob and rule version; only pairs it lacks are scanned, and
findings are joined back to all paths that carry the blob.  DataFrame functions
only.

Null texts count as empty.  An empty table gives no rows.  Repeated rows and
copies share one scan and each get the findings.  Columns other than the key
and the text are ignored, whatever their names.  A very long text is scanned whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetweave.llm.spans import all_matches, located
from packetweave.storage import materialize

# The base kinds in their order, their patterns, then added kinds.
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
VALUE = r"[A-Za-z0-9+/_.=-]"
RULES = {
    "assign": rf"""{KEYWORDS}["']?\x20*[:=]\x20*["']?{VALUE}++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "pem": r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----",
    "github": r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+",
}
BASE = ("assign", "access", "hex")
SHORTEST_VALUE = 6
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_version(rules: dict[str, str] | None = None) -> str:
    """Changes whenever a rule does, so that a changed rule scans every blob again."""
    listed = "\n".join(f"{k} {v}" for k, v in (rules or RULES).items())
    return hashlib.sha256(f"{SHORTEST_VALUE}\n{listed}".encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find_secrets(blobs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Adds ``findings``, sorted by start and then kind, to rows with ``text``."""
    rules = rules or RULES
    found = blobs.withColumns({f"_{k}": all_matches(F.col("text"), p) for k, p in rules.items()})
    kinds = []
    for rank, (kind, pattern) in enumerate(rules.items()):
        spans = located(F.col("text"), F.col(f"_{kind}"), pattern)
        if kind == "assign":
            # The value is what follows the first separator, past blanks and a quote.
            value = rf"^{KEYWORDS}[\"']?\x20*[:=]\x20*[\"']?({VALUE}+)$"
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["text"], value, 1)) >= SHORTEST_VALUE)
        kinds.append(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))))
    return found.withColumn("findings", F.array_sort(F.concat(*kinds)).cast(FINDINGS)).drop(*(f"_{k}" for k in rules))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) of the pairs that ``ledger`` lacks.

    Texts of equal blobs are merged by partial aggregation before the shuffle,
    so a blob that holds a third of all versions sends one text per task.
    """
    version = rule_version(rules)
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    distinct = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        distinct = distinct.join(seen, "blob", "left_anti")
    return find_secrets(distinct, rules).select("blob", F.lit(version).alias("rule_version"), "findings")


def scan_history(
    versions: DataFrame, key: str = "doc_id", text: str = "text",
    ledger: DataFrame | None = None, rules: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the new ledger rows to append to ``ledger``."""
    paths = versions.select(F.col(key).alias("path"), F.col(text).alias("text"))
    new = materialize(scan_unseen(paths, ledger, rules), "secret-ledger")
    known = new
    if ledger is not None:
        old = ledger.filter(F.col("rule_version") == rule_version(rules)).dropDuplicates(["blob"])
        known = new.unionByName(old.select("blob", "rule_version", "findings"))
    addressed = paths.select("path", blob_id(F.col("text")).alias("blob"))
    return addressed.join(known.select("blob", "findings"), "blob", "left").select(
        F.col("path").alias(key), "blob", "findings"), new
