"""Scans: text column in, findings column out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import FINDINGS, empty, locate, matched_rules, rule_findings, with_once
from ..functions.text import as_map, constant, is_blank, let, line_text, remembered, split_lines
from ..rules import PII_RULES, SECRET_RULES, SEVERITY_RANK, VULNERABILITY_RULES, select_rules

SCORE = "decimal(4,2)"


def hundredths(score: float) -> int:
    return int(round(score * 100))


def pii_column(
    text: Column, rules=PII_RULES, entities=None, threshold: float = 0.5,
    context_boost: float = 0.35, context_window: int = 5, ignore_case: bool = False,
) -> Column:
    """SCAN-PII: findings of all wanted rules at or above the threshold."""
    chosen = select_rules(rules, entities)
    if ignore_case:
        chosen = tuple(r.ignoring_case() for r in chosen)
    boost = hundredths(context_boost)
    least = hundredths(threshold)
    # A rule that cannot reach the threshold even when boosted need not run.
    chosen = [r for r in chosen if r.pct + (boost if r.context else 0) >= least]
    found = rule_findings(text, chosen, boost, context_window)
    if any(r.pct < least for r in chosen):
        found = F.filter(found, lambda f: f["pct"] >= least)
    return F.when(is_blank(text), empty(FINDINGS)).otherwise(found)


def secret_column(text: Column, rules=SECRET_RULES) -> Column:
    """SCAN-SEC: credential findings; spans cover the masked part only."""
    return rule_findings(text, rules, boost=0)


VULNERABILITY = "struct<rule_no:int,line:int,start:int>"


def vulnerability_column(text: Column, rules=VULNERABILITY_RULES) -> Column:
    """SCAN-VULN: first match per (rule, line) over the whole text."""
    def of_rule(hit):
        def first_per_line(matches):
            first = F.filter(matches, lambda m, i: (i == 0) | (
                F.get(matches, i - 1)["line"] != m["line"]
            ))
            return F.transform(first, lambda m: F.struct(
                hit["no"].alias("rule_no"), m["line"].alias("line"), m["start"].alias("start")
            ))

        return let(locate(hit["pieces"], F.lit(0)), first_per_line)

    return F.flatten(F.transform(matched_rules(text, rules), of_rule)).cast(f"array<{VULNERABILITY}>")


def scan(df: DataFrame, text: str = "text", into: str = "findings", **options) -> DataFrame:
    """Add the array of raw PII findings to each document."""
    return with_once(df, into, remembered(pii_column, text, **options))


def scan_secrets(df: DataFrame, text: str = "text", into: str = "findings", rules=SECRET_RULES) -> DataFrame:
    return with_once(df, into, remembered(secret_column, text, rules=rules))


def explode_findings(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding.

    ``explode_outer`` plus a filter on its output: a plain ``explode`` makes the
    optimizer test the size of the array below, at the price of computing it twice.
    """
    f = F.col("_f")
    return (
        df.select(*keys, F.explode_outer(findings).alias("_f"))
        .where(f["start"].isNotNull())
        .select(
            *keys, f["entity"].alias("entity"), f["label"].alias("label"), f["rule"].alias("rule"),
            f["start"].alias("start"), f["end"].alias("end"),
            (f["pct"] / F.lit(100)).cast(SCORE).alias("score"),
            f["line"].alias("line_number"), f["value"].alias("value"),
        )
    )


def collect_findings(rows: DataFrame, key: str) -> DataFrame:
    """Findings rows back to one array per document, e.g. to merge recognizers."""
    return rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(
            "start", "end", (F.col("score") * 100).cast("int").alias("pct"), "entity", "label",
            "rule", F.col("line_number").alias("line"), "value",
        ))).cast(FINDINGS).alias("findings")
    )


def add_findings(df: DataFrame, rows: DataFrame, key: str, findings: str = "findings") -> DataFrame:
    """SET-1: union the findings of another recognizer (gazetteer join, user hook)."""
    extra = collect_findings(rows, key).withColumnRenamed("findings", "_extra")
    joined = df.join(extra, key, "left")
    both = F.concat(F.col(findings), F.coalesce(F.col("_extra"), empty(FINDINGS)))
    return joined.withColumn(findings, both).drop("_extra")


def scan_report(df: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """All raw findings with rounded scores; rows of a document come by start (SORT-2).

    The order is that of the sorted array in each row: no sort across documents.
    """
    found = scan(df.select(key, text), text, **options)
    rows = explode_findings(found.withColumn("findings", F.sort_array("findings")), [key])
    return rows.select(
        key, F.col("entity").alias("entity_type"), "value", F.round("score", 2).alias("score"),
        "start", "end",
    )


def secret_report(df: DataFrame, key: str, findings: str = "findings", rules=SECRET_RULES) -> DataFrame:
    """Secret findings with description and whole per cent."""
    texts = as_map({r.rule: r.description for r in rules})
    return (
        explode_findings(df, [key], findings)
        .withColumn("description", F.try_element_at(texts, F.col("rule")))
        .withColumn("percent", (F.col("score") * 100).cast("int"))
    )


SEC_COLUMNS = (
    "rule_id", "title", "description", "severity", "line_number", "line_text", "cwe", "advice",
    "source",
)


def scan_vulnerabilities(
    df: DataFrame, key: str, text: str = "text", ext: str | None = None, rules=VULNERABILITY_RULES,
) -> DataFrame:
    """One row per (document, rule, line), with the report texts of the rule.

    The text does not ride through the explode: the line is cut out while the
    finding is still in its row.
    """
    keep = [key] + ([ext] if ext else [])
    scanned = with_once(df.select(*keep, text), "_v", remembered(vulnerability_column, text, rules=rules))

    def with_line(lines):
        return F.transform(F.col("_v"), lambda v: F.struct(
            v["rule_no"].alias("rule_no"), v["line"].alias("line"), v["start"].alias("start"),
            line_text(lines, v["line"]).alias("text"),
        ))

    hits = scanned.select(
        *keep,
        F.explode_outer(
            F.when(F.size("_v") > 0, let(split_lines(F.col(text)), with_line))
        ).alias("_v"),
    ).where(F.col("_v").isNotNull())
    v = F.col("_v")

    fields = ("rule_id", "title", "description", "severity", "cwe", "advice")
    table = constant(
        [{f: getattr(r, f) for f in fields} for r in rules],
        "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>",
    )
    rule = F.get(table, v["rule_no"])
    out = hits.select(
        *keep,
        *[rule[f].alias(f) for f in fields[:4]],
        v["line"].alias("line_number"), v["text"].alias("line_text"),
        *[rule[f].alias(f) for f in fields[4:]],
        F.lit("custom").alias("source"),
        v["rule_no"].alias("rule_no"), v["start"].alias("start"),
    )
    if ext and any("any" not in r.languages for r in rules):
        kinds = constant({r.rule_id: r.languages for r in rules}, "map<string,array<string>>")
        langs = F.element_at(kinds, F.col("rule_id"))
        out = out.where(F.array_contains(langs, F.lit("any")) | F.array_contains(langs, F.col(ext)))
    return out


def severity_rank(severity: Column) -> Column:
    return F.element_at(constant(SEVERITY_RANK, "map<string,int>"), severity)
