"""Numbering, vaults and masking within one document: no shuffle at all.

One document has one vault, as long as the caller does not ask for a vault that
spans several documents (see ``sessions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spans import resolve_overlaps, splice, with_once
from ..functions.text import is_blank, let, placeholder, remembered
from .filters import settle
from .scan import pii_column, secret_column

BACKWARD = "backward"
FORWARD = "forward"
VAULT_ENTRY = "struct<placeholder:string,label:string,n:int,value:string,seq:int>"


def registration(findings: Column, order: str) -> Column:
    """Findings in the order in which their values enter the vault."""
    ordered = F.sort_array(findings)
    return F.reverse(ordered) if order == BACKWARD else ordered


def numbering(findings: Column, order: str) -> Column:
    """(``of``: place in the vault of every finding's value, ``entries``: the vault of the document).

    Places count from 0 in order of registration.  Everything is found by sorting, nothing by search, so
    the time grows with n log n.
    """
    def place(f, i):
        return F.struct(f.alias("f"), i.alias("i"))

    def sorted_by_value(ordered):
        return F.sort_array(F.transform(ordered, lambda p, at: F.struct(
            p["f"]["label"].alias("label"), p["f"]["value"].alias("value"), at.alias("at"), p["i"].alias("i"),
        )))

    def runs_of(found):
        """Where the runs of equal (label, value) begin."""
        def begins(j):
            here, before = F.get(found, j), F.get(found, j - 1)
            return (j == 0) | (here["label"] != before["label"]) | (here["value"] != before["value"])

        return let(F.filter(F.sequence(F.lit(0), F.size(found) - 1), begins), lambda starts: let(
            F.sort_array(F.transform(starts, lambda j, r: F.struct(
                F.get(found, j)["at"].alias("at"), F.get(found, j)["label"].alias("label"),
                F.get(found, j)["value"].alias("value"), r.alias("r"),
            ))),
            lambda runs: F.struct(places(found, starts, runs).alias("of"), entries(runs).alias("entries")),
        ))

    def places(found, starts, runs):
        ranks = F.sort_array(F.transform(runs, lambda x, k: F.struct(x["r"].alias("r"), k.alias("k"))))

        def members(rank):
            last = F.coalesce(F.get(starts, rank["r"] + 1), F.size(found)) - 1
            return F.transform(F.sequence(F.get(starts, rank["r"]), last), lambda j: F.struct(
                F.get(found, j)["i"].alias("i"), rank["k"].alias("k"),
            ))

        return F.transform(F.sort_array(F.flatten(F.transform(ranks, members))), lambda x: x["k"])

    def entries(runs):
        def counted(grouped):
            names = F.transform(grouped, lambda x: x["label"])
            first = F.map_from_entries(F.transform(
                F.array_distinct(names), lambda label: F.struct(label, F.array_position(names, label))
            ))
            # a map of labels, of which there are as many as rules
            return let(first, lambda opened: F.sort_array(F.transform(grouped, lambda x, m: F.struct(
                x["k"].alias("k"), (m + 2 - F.element_at(opened, x["label"])).cast("int").alias("n"),
            ))))

        grouped = F.sort_array(F.transform(runs, lambda x, k: F.struct(x["label"].alias("label"), k.alias("k"))))
        numbers = let(grouped, counted)

        def entry(x, number):
            return F.struct(
                placeholder(x["label"], number["n"]).alias("placeholder"), x["label"].alias("label"),
                number["n"].alias("n"), x["value"].alias("value"), (number["k"] + 1).alias("seq"),
            )

        return F.zip_with(runs, numbers, entry).cast(f"array<{VAULT_ENTRY}>")

    kind = f"struct<of:array<int>,entries:array<{VAULT_ENTRY}>>"
    none = F.struct(F.array().alias("of"), F.array().alias("entries")).cast(kind)
    ordered = registration(F.transform(findings, place), order)
    return F.when(F.size(findings) == 0, none).otherwise(let(sorted_by_value(ordered), runs_of).cast(kind))


def mask_findings(
    df: DataFrame, text: str, findings: str, order: str, masked: str = "masked", vault: str = "vault",
) -> DataFrame:
    """MASK-1 / MASK-2: add vault and masked text; documents without findings pass through."""
    numbered = F.col("_numbered")
    marks = F.transform(numbered["of"], lambda k: F.get(numbered["entries"], k)["placeholder"])
    body = splice(F.col(text), F.col(findings), marks)
    return (
        with_once(df, "_numbered", numbering(F.col(findings), order))
        .withColumn(vault, numbered["entries"])
        .withColumn(masked, F.when(is_blank(F.col(text)), F.lit("")).otherwise(body))
        .drop("_numbered")
    )


def pii_findings(text: Column, allowed=(), **options) -> Column:
    return settle(pii_column(text, **options), allowed=allowed)


def secret_findings(text: Column, **options) -> Column:
    return resolve_overlaps(secret_column(text, **options))


def find_pii(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds the ``findings`` of document mode: scanned, cleaned, without overlaps."""
    return with_once(df, "findings", remembered(pii_findings, text, **options))


def find_secrets(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds the ``findings`` of code mode: credentials without overlaps."""
    return with_once(df, "findings", remembered(secret_findings, text, **options))


def mask_documents(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Document mode: adds ``findings``, ``vault`` and ``masked``."""
    return mask_findings(find_pii(df, text, **options), text, "findings", BACKWARD)


def mask_code(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Code mode: adds ``findings``, ``vault`` and ``masked``."""
    return mask_findings(find_secrets(df, text, **options), text, "findings", FORWARD)


def explode_vault(df: DataFrame, session: str, vault: str = "vault") -> DataFrame:
    """Vault rows of masked documents, with the document as session."""
    e = F.col("_e")
    return (
        df.select(F.col(session).alias("session_id"), F.explode_outer(vault).alias("_e"))
        .where(e["placeholder"].isNotNull())
        .select("session_id", *[e[c].alias(c) for c in ("placeholder", "label", "n", "value", "seq")])
    )
