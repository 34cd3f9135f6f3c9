"""Reports over findings and vaults: plain aggregates, all with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.spans import with_once
from ..functions.text import constant, let, remembered, snippet, split_lines, strip, title_case
from ..rules import BLOCKING, EXTERNAL_ADVICE, MINOR, VULNERABILITY_RULES
from .mask import find_secrets
from .scan import SEC_COLUMNS, severity_rank, vulnerability_column

EXTERNAL_SCHEMA = (
    "results array<struct<test_id:string,test_name:string,issue_text:string,"
    "issue_severity:string,line_number:int,code:string,issue_cwe:struct<id:int>>>"
)


def type_counts(vault: DataFrame) -> DataFrame:
    """AGG-1: distinct vault entries per label."""
    return vault.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("n"))


def in_order(counts: DataFrame, key: str, by: str = "label", into: str = "place") -> DataFrame:
    """SORT-3 as a column: place of each count of a document or session in the order of its label."""
    return counts.withColumn(into, F.row_number().over(W.partitionBy(key).orderBy(by)))


def vault_totals(vault: DataFrame) -> DataFrame:
    """AGG-4, VLT-4: entries and types per session."""
    return vault.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("label").alias("types")
    )


def secret_counts(findings: DataFrame, key: str) -> DataFrame:
    """AGG-2: occurrences per secret label."""
    return findings.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    """AGG-3: findings per severity class of a document."""
    s = F.col("severity")
    return findings.groupBy(key).agg(
        F.count_if(s == "CRITICAL").alias("critical"), F.count_if(s == "HIGH").alias("high"),
        F.count_if(s == "MEDIUM").alias("medium"), F.count_if(s.isin(*MINOR)).alias("low"),
    )


def blockers(findings: DataFrame, key: str) -> DataFrame:
    """AGG-5, FLT-13: whether a document has a CRITICAL or HIGH finding."""
    return findings.groupBy(key).agg(
        F.bool_or(F.col("severity").isin(*BLOCKING)).alias("has_blockers")
    )


def _status(has_blockers: Column, secrets: Column) -> Column:
    return (
        F.when(has_blockers & (secrets == 0), "unsafe_no_secrets").when(has_blockers, "masked_but_unsafe")
        .when(secrets > 0, "safe_masked").otherwise("clean")
    )


def final_status(docs: DataFrame, findings: DataFrame, secrets: DataFrame, key: str) -> DataFrame:
    """AGG-6 from tables of findings: one of four outcomes per document; only keys and counts are shuffled."""
    masked = secrets.groupBy(key).agg(F.count(F.lit(1)).alias("secrets"))
    return (
        docs.select(key)
        .join(blockers(findings, key), key, "left")
        .join(masked, key, "left")
        .select(
            key, F.coalesce("has_blockers", F.lit(False)).alias("has_blockers"),
            F.coalesce("secrets", F.lit(0)).alias("secrets"),
        )
        .withColumn("status", _status(F.col("has_blockers"), F.col("secrets")))
    )


def status_of_texts(df: DataFrame, key: str, text: str = "text", rules=VULNERABILITY_RULES) -> DataFrame:
    """AGG-6 in the row: each text is scanned once for both kinds of findings, and nothing is shuffled."""
    blocking = constant([r.severity in BLOCKING for r in rules], "array<boolean>")
    found = with_once(find_secrets(df.select(key, text), text), "_v", remembered(vulnerability_column, text, rules=rules))
    return found.select(
        key, F.exists("_v", lambda v: F.get(blocking, v["rule_no"])).alias("has_blockers"),
        F.size("findings").cast("long").alias("secrets"),
    ).withColumn("status", _status(F.col("has_blockers"), F.col("secrets")))


def external_findings(reports: DataFrame, key: str, results: str = "results") -> DataFrame:
    """VUL-21: findings of an outside code scanner, from its parsed JSON reports."""
    r = F.col("_r")
    severity = F.upper(F.coalesce(r["issue_severity"], F.lit("LOW")))
    return (
        reports.select(key, F.posexplode_outer(results).alias("_pos", "_r"))
        .where(F.col("_pos").isNotNull())
        .select(
            key,
            F.coalesce(r["test_id"], F.lit("B000")).alias("rule_id"),
            title_case(F.coalesce(r["test_name"], F.lit("Bandit Issue"))).alias("title"),
            F.coalesce(r["issue_text"], F.lit("")).alias("description"),
            F.when(severity.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), severity)
            .otherwise("LOW").alias("severity"),
            F.coalesce(r["line_number"], F.lit(0)).alias("line_number"),
            strip(F.coalesce(r["code"], F.lit(""))).alias("line_text"),
            F.coalesce(r["issue_cwe"]["id"].cast("string"), F.lit("")).alias("cwe"),
            F.lit(EXTERNAL_ADVICE).alias("advice"),
            F.lit("bandit").alias("source"),
            F.col("_pos").alias("rule_no"),
            F.lit(0).alias("start"),
        )
    )


def merge_findings(custom: DataFrame, key: str, external: DataFrame | None = None,
                   ext: str | None = None, show_low: bool = True) -> DataFrame:
    """AGG-8, SET-2, FLT-11, FLT-14: one finding per (document, title, line).

    External findings come first; those of other files than Python are left out
    when ``ext`` names the extension column of ``external``.  The first is taken by
    a ``min`` over structs, which combines on the map side, so copies of one finding
    do not meet in one task.
    """
    custom = custom.withColumn("_source", F.lit(1))
    both = custom.select(key, *SEC_COLUMNS, "rule_no", "start", "_source")
    if external is not None:
        if ext:
            external = external.where(F.col(ext) == "py")
        both = both.unionByName(
            external.withColumn("_source", F.lit(0)).select(key, *SEC_COLUMNS, "rule_no", "start", "_source")
        )
    rest = [c for c in SEC_COLUMNS if c not in ("title", "line_number")]
    first = both.groupBy(key, "title", "line_number").agg(
        F.min(F.struct("_source", "rule_no", "start", *rest)).alias("_f")
    )
    out = first.select(
        key, *[F.col(c) if c in ("title", "line_number") else F.col("_f")[c].alias(c) for c in SEC_COLUMNS],
        F.col("_f")["_source"].alias("source_rank"), F.col("_f")["rule_no"].alias("rule_no"),
        severity_rank(F.col("_f")["severity"]).alias("sev_rank"),
    )
    return out if show_low else out.where(~F.col("severity").isin(*MINOR))


def ranked(findings: DataFrame, key: str) -> DataFrame:
    """SORT-1 as a column: place of each finding by severity, line, then insertion."""
    order = W.partitionBy(key).orderBy("sev_rank", "line_number", "source_rank", "rule_no")
    return findings.withColumn("place", F.row_number().over(order))


def blocking_details(findings: DataFrame) -> DataFrame:
    """TOPK-1: the CRITICAL and HIGH findings."""
    return findings.where(F.col("severity").isin(*BLOCKING))


def riskiest(counts: DataFrame, key: str, k: int) -> DataFrame:
    """TOPK-1 over a corpus: the k documents with the most severe findings."""
    return counts.orderBy(
        F.desc("critical"), F.desc("high"), F.desc("medium"), F.desc("low"), F.asc(key)
    ).limit(k)


def exposure(rows: DataFrame, dims: list[str], key: str, measure: str = "label") -> DataFrame:
    """AGG-9: findings and documents per dimension with subtotals and grand total."""
    return rows.rollup(*dims, measure).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct(key).alias("documents"),
    )


def shared_values(vault: DataFrame, at_least: int = 2) -> DataFrame:
    """AGG-10: hashed values that occur in several documents."""
    return (
        vault.groupBy("label", F.sha2("value", 256).alias("value_hash"))
        .agg(F.count_distinct("session_id").alias("documents"))
        .where(F.col("documents") >= at_least)
    )


def shared_values_approx(vault: DataFrame, at_least: int = 2, rsd: float = 0.02) -> DataFrame:
    """AGG-10 with sketches beside the exact counts: ``within`` says whether a sketch is at most 5 ``rsd`` off."""
    both = vault.groupBy("label", F.sha2("value", 256).alias("value_hash")).agg(
        F.count_distinct("session_id").alias("documents"),
        F.approx_count_distinct("session_id", rsd).alias("_sketch"),
    )
    off = F.abs(F.col("_sketch") - F.col("documents"))
    return both.where(F.col("documents") >= at_least).select(
        "label", "value_hash", "documents", (off <= F.greatest(F.lit(1.0), 5 * rsd * F.col("documents"))).alias("within")
    )


def snippets(docs: DataFrame, findings: str, key: str, text: str = "text", around: int = 2) -> DataFrame:
    """PRJ-7, JOIN-8: the lines around each finding, cut while text and findings share a row."""
    def cut(lines):
        return F.transform(findings, lambda f: F.struct(
            f["label"].alias("label"), f["line"].alias("line_number"), f["start"].alias("start"),
            F.greatest(f["line"] - around, F.lit(1)).alias("first_line"),
            snippet(lines, f["line"], around).alias("snippet"),
        ))

    s = F.col("_s")
    return (
        docs.select(key, F.explode_outer(
            F.when(F.size(findings) > 0, let(split_lines(F.col(text)), cut))
        ).alias("_s"))
        .where(s.isNotNull())
        .select(key, "_s.*")
    )
