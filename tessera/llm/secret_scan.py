"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row
per (blob, rule version) with that blob's findings; a scan reads only the pairs it lacks, appends
them, and joins findings back to all paths that ever held the blob. Hashes travel, texts don't: which
blobs are new and which rows repeat one is settled on hashes, one row of each new blob is scanned
where it lies, and the key sets are broadcast where they fit. All of it is DataFrame code: matches come from regexp_extract_all, their places from the lengths of the gaps that split leaves
between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, sized, text_or_empty

#: Bytes that a broadcast hash with its path, and a finding takes, generously.
BLOB_BYTES, FINDING_BYTES = 192, 96
FINDING = "array<struct<start:long,ord:int,kind:string,end:long>>"


@dataclass(frozen=True)
class Rule:
    """kind: name in the results. pattern: Java regular expression without lookaround. group and
    least: what must have so many code points. hint: a literal-like pattern that every match has,
    tested first, so that most texts cost one pass."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: The base rules of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "(?i)passw|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
#: Rules beyond the contract; their spans are added to the base ones.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, "eyJ[A-Za-z0-9_-]+[.]eyJ"),
)
RULES = BASE + ADDED


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes with any rule, so that a changed rule set scans every blob again."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in text: leftmost, non-overlapping, failing ones dropped and not retried."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(whole.alias("m"), F.transform(part, lambda p: F.char_length(p)).alias("n"), F.transform(gaps, lambda g: F.char_length(g)).alias("g"))
    # The state: where the last match ended, and the spans so far. The last gap has no match.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(FINDING).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["g"]
        end = begin + F.char_length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["n"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    folded = F.aggregate(F.filter(parts, lambda x: x["m"].isNotNull()), start, step, lambda s: s["found"])
    return F.when(text.rlike(rule.hint), folded).otherwise(F.array().cast(FINDING))


def scan_unseen(history: DataFrame, ledger: DataFrame | None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ledger's missing rows: blob, rule_version, findings (ordered by start, then rule).

    ledger: blob, rule_version, findings as earlier scans returned them, or None. Of rows with one
    content, that of the smallest path is scanned; rows that share the path too meet afterwards.
    """
    version = rule_version(rules)
    text = text_or_empty(text_col)
    versions = materialize(history.select(F.sha2(text, 256).alias("blob"), F.col(path_col).alias("path")), "versions")
    rows = history.select(F.col(path_col).alias("_path"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    if ledger is not None:
        seen = materialize(ledger.filter(F.col("rule_version") == version).select("blob").distinct(), "seen")
        new = materialize(versions.select("blob").distinct().join(seen, "blob", "left_anti"), "new")
        few = sized(new, BLOB_BYTES, broadcast_bytes)
        rows = rows.join(few, "blob", "left_semi") if few is not new else rows.join(sized(seen, BLOB_BYTES, broadcast_bytes), "blob", "left_anti")
        versions = versions.join(new, "blob", "left_semi")
    repeated = versions.groupBy("blob").agg(F.count("*").alias("n"), F.min("path").alias("_first")).filter("n > 1").select("blob", F.lit(True).alias("_repeated"), "_first")
    rows = rows.join(sized(materialize(repeated, "repeated"), BLOB_BYTES, broadcast_bytes), "blob", "left")
    rows = rows.filter(F.col("_repeated").isNull() | F.col("_path").eqNullSafe(F.col("_first")))
    found = F.array_sort(F.concat(*[spans_of(F.col("text"), r, k) for k, r in enumerate(rules)]))
    return rows.select("blob", F.lit(version).alias("rule_version"), found.alias("findings")).dropDuplicates(["blob"])


def extend_ledger(history: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The whole ledger after a scan, and its new rows alone, which the caller appends to the
    stored ledger. The new rows are a written table; nothing is scanned twice."""
    delta = materialize(scan_unseen(history, ledger, path_col, text_col, rules, broadcast_bytes), "ledger")
    return (delta if ledger is None else ledger.unionByName(delta)), delta


def findings_by_path(history: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, findings: one row per row of history, with an empty array where nothing is
    found. A null text is an empty blob; null and repeated paths keep their rows; extra columns
    are ignored, whatever their names; an empty table gives no rows."""
    hits = ledger.filter((F.col("rule_version") == rule_version(rules)) & (F.size("findings") > 0)).select("blob", "findings")
    spans = hits.agg(F.count("*").alias("n"), F.sum(F.size("findings")).alias("m")).first()
    if spans["n"] * BLOB_BYTES + (spans["m"] or 0) * FINDING_BYTES <= BROADCAST_BYTES:
        hits = F.broadcast(hits)
    paths = history.select(F.col(path_col).alias("path"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    return paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
