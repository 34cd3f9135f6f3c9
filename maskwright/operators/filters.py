"""Clean-up of raw findings between scan and overlap resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import FINDINGS, resolve_overlaps
from ..functions.text import let, strip
from ..rules import LOCATION_DENYLIST, NAME_DENYLIST, SEPARATORS, STRUCTURAL_IDS

SEPARATOR_CLASS = f"[{SEPARATORS}]"


def clip_at_pipe(findings: Column) -> Column:
    """FLT-10: a span that crosses a field border ends before the border.

    The kept text is the stripped part before the pipe and at least two characters
    long; the start stays where it was, so the value is what the text holds there.
    """
    def clipped(f):
        before = F.substring_index(f["value"], "|", 1)
        kept = F.length(strip(before))
        return F.struct(
            f["start"].alias("start"), (f["start"] + kept).alias("end"), f["pct"].alias("pct"),
            f["entity"].alias("entity"), f["label"].alias("label"), f["rule"].alias("rule"),
            f["line"].alias("line"),
            F.substring(f["value"], F.lit(1), kept).alias("value"),
        )

    def crosses(f):
        return F.contains(f["value"], F.lit("|"))

    short = F.filter(findings, lambda f: ~crosses(f) | (
        F.length(strip(F.substring_index(f["value"], "|", 1))) > 1
    ))
    return F.transform(short, lambda f: F.when(crosses(f), clipped(f)).otherwise(f)).cast(FINDINGS)


def is_false_positive(entity: Column, value: Column, names, locations) -> Column:
    """FLT-4 to FLT-9 for one span."""
    def visible(char):
        return char.between("!", "~")

    # most values neither start nor end with a blank
    clean = visible(F.substring(value, 1, 1)) & visible(F.substring(value, -1, 1))
    return let(F.when(clean, value).otherwise(strip(value)), lambda bare: _is_noise(entity, bare, names, locations))


def _is_noise(entity: Column, bare: Column, names, locations) -> Column:
    person = entity == "PERSON"
    # separators anywhere cover spans made of separators only
    shape = bare.rlike("(?U)" + "|".join([SEPARATOR_CLASS, *(f"(?:{p})" for p in STRUCTURAL_IDS)]))
    all_caps = (
        person & bare.rlike(r"\p{Lu}") & ~bare.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(bare) > 2)
    )
    result = shape | all_caps
    if names:
        result = result | (person & F.lower(bare).isin(*names))
    if locations:
        result = result | ((entity == "LOCATION") & F.lower(bare).isin(*locations))
    return result


def drop_false_positives(
    findings: Column, names=NAME_DENYLIST, locations=LOCATION_DENYLIST, allowed=(),
) -> Column:
    """FLT-4 to FLT-9, then the user's safe values (UDF-5)."""
    kept = F.filter(findings, lambda f: ~is_false_positive(f["entity"], f["value"], names, locations))
    if allowed:
        kept = F.filter(kept, lambda f: ~f["value"].isin(*allowed))
    return kept


def false_positives(findings: Column, names=NAME_DENYLIST, locations=LOCATION_DENYLIST) -> Column:
    """The findings that ``drop_false_positives`` drops for FLT-4 to FLT-9."""
    return F.filter(findings, lambda f: is_false_positive(f["entity"], f["value"], names, locations))


def settle(findings: Column, names=NAME_DENYLIST, locations=LOCATION_DENYLIST, allowed=()) -> Column:
    """Clip, drop false positives, resolve overlaps: the fixed order of document mode."""
    return resolve_overlaps(drop_false_positives(clip_at_pipe(findings), names, locations, allowed))


def without_values(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """JOIN-5 / UDF-4 / UDF-5 with a table of values: left-anti join on its columns.

    No hint: Spark broadcasts the table when its measured size allows and
    shuffles both sides otherwise.
    """
    return rows.join(values.select(*on).distinct(), on, "left_anti")


def drop_denied(rows: DataFrame, denied: DataFrame) -> DataFrame:
    """JOIN-5 with a table ``(entity, value)`` of lower-cased denied values."""
    keyed = rows.withColumn("_denied", F.lower(strip(F.col("value"))))
    table = denied.select("entity", F.col("value").alias("_denied")).distinct()
    return keyed.join(table, ["entity", "_denied"], "left_anti").drop("_denied")


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """JOIN-2 report: findings that overlap the best-ranked one covering their start.

    Row-local test of each finding against the kept ones of its document, rather
    than a self-join of all pairs.
    """
    from .scan import collect_findings

    docs = collect_findings(rows, key).withColumn("_kept", resolve_overlaps(F.col("findings")))
    lost = F.filter("findings", lambda f: ~F.exists("_kept", lambda k: (
        (k["start"] == f["start"]) & (k["end"] == f["end"]) & (k["rule"] == f["rule"])
        & (k["entity"] == f["entity"])
    )))
    f = F.col("_f")
    winner = F.get(F.filter("_kept", lambda k: (k["start"] < f["end"]) & (k["end"] > f["start"])), F.lit(0))
    return (
        docs.select(key, "_kept", F.explode_outer(lost).alias("_f"))
        .where(F.col("_f")["start"].isNotNull())
        .select(
            key, f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end"),
            winner["rule"].alias("kept_rule"), winner["start"].alias("kept_start"),
            winner["end"].alias("kept_end"),
        )
    )
