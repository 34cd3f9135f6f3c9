"""Vaults that span several documents, up to one vault for a whole corpus.

A session may hold any share of the data, so nothing is gathered per session:
values are made distinct by a pre-aggregated group-by, numbered by ranges, and
joined back per (session, label, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.spans import splice, with_once
from ..functions.text import is_blank, placeholder
from .joins import checkpointed, join_hot_keys, left_join_hot_keys, number_rows
from .mask import BACKWARD, numbering

VALUE_KEYS = ["session_id", "label", "value"]
VAULT_COLUMNS = ["session_id", "placeholder", "label", "n", "value", "seq"]


def session_values(
    docs: DataFrame, session: str, sequence: str, findings: str = "findings", order: str = BACKWARD,
) -> DataFrame:
    """Distinct values per session with the place of their first registration.

    Documents enter in the order of ``sequence`` (unique in a session); inside a
    document the order is that of document or code mode.
    """
    f = F.col("_f")
    rows = (
        docs.select(
            F.col(session).alias("session_id"), F.col(sequence).cast("long").alias("sequence"),
            F.explode_outer(findings).alias("_f"),
        )
        .where(f["start"].isNotNull())
        .select(
            "session_id", f["label"].alias("label"), f["value"].alias("value"), "sequence",
            (-f["start"] if order == BACKWARD else f["start"]).alias("pos"),
        )
    )
    return rows.groupBy(*VALUE_KEYS).agg(
        F.min(F.struct("sequence", "pos")).alias("_at")
    ).select(*VALUE_KEYS, F.col("_at")["sequence"].alias("sequence"), F.col("_at")["pos"].alias("pos"))


def build_vault(values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """VLT-1 to VLT-3: number new values per label (64 bits), after those of an existing vault.

    Returns the new entries only; ``append_vault`` gives old and new together.
    """
    if existing is not None:
        values = values.join(existing.select(*VALUE_KEYS), VALUE_KEYS, "left_anti")
    numbers = {"seq": ["session_id"], "n": ["session_id", "label"]}
    numbered = number_rows(values, numbers, ["sequence", "pos"])
    if existing is not None:
        by_label = existing.groupBy("session_id", "label").agg(F.max("n").alias("_n0"))
        by_session = existing.groupBy("session_id").agg(F.max("seq").alias("_seq0"))
        # a session may hold most of the new values
        labelled = left_join_hot_keys(checkpointed(numbered), by_label, ["session_id", "label"])
        numbered = (
            left_join_hot_keys(checkpointed(labelled), by_session, ["session_id"])
            .withColumn("n", F.col("n") + F.coalesce("_n0", F.lit(0)))
            .withColumn("seq", F.col("seq") + F.coalesce("_seq0", F.lit(0)))
        )
    return numbered.withColumn("placeholder", placeholder(F.col("label"), F.col("n"))).select(
        *VAULT_COLUMNS
    )


def append_vault(values: DataFrame, existing: DataFrame) -> DataFrame:
    """SET-3: the merged vault, old entries unchanged."""
    return existing.select(*VAULT_COLUMNS).unionByName(build_vault(values, existing))


def mask_with_vault(
    docs: DataFrame, findings: DataFrame, vault: DataFrame, key: str, session: str,
    text: str = "text",
) -> DataFrame:
    """MASK-1 over a vault table: ``docs`` plus ``masked``.

    ``findings`` is ``(key, session, findings)`` of the documents that have any.
    Only distinct (document, label, value) rows meet the vault.  The texts meet their
    marks by document key: a broadcast when the marks are small, no exchange of texts
    when the corpus is bucketed by that key, else one shuffle.
    """
    found = with_once(
        findings.select(F.col(session).alias("session_id"), F.col(key).alias("_key"), "findings"),
        "_numbered", numbering(F.col("findings"), BACKWARD),
    )
    wanted = found.select("session_id", "_key", F.posexplode("_numbered.entries").alias("_k", "_e")).select(
        "session_id", "_key", "_k", F.col("_e.label").alias("label"), F.col("_e.value").alias("value")
    )
    named = join_hot_keys(wanted, vault.select(*VALUE_KEYS, "placeholder"), VALUE_KEYS)
    # the values of a document in the order of its own numbering
    names = named.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_k", "placeholder"))).alias("_names"))
    lookup = found.join(names, "_key").select(
        "_key", "findings",
        F.transform("_numbered.of", lambda k: F.get(F.col("_names"), k)["placeholder"]).alias("_marks"),
    )
    joined = docs.join(lookup.withColumnRenamed("_key", key), key, "left")
    body = F.when(F.col("_marks").isNull(), F.col(text)).otherwise(
        splice(F.col(text), F.col("findings"), F.col("_marks"))
    )
    return joined.withColumn(
        "masked", F.when(is_blank(F.col(text)), F.lit("")).otherwise(body)
    ).drop("findings", "_marks")


def mask_sessions(
    docs: DataFrame, found, key: str, session: str, sequence: str, text: str = "text",
    existing: DataFrame | None = None, order: str = BACKWARD,
) -> tuple[DataFrame, DataFrame]:
    """Scan once, number per session, mask: returns (masked documents, vault).

    ``found`` is the findings column.  The scan result, small next to the texts, is
    checkpointed since both the vault and the mask read it.
    """
    hits = checkpointed(
        with_once(docs, "findings", found)
        .select(key, session, sequence, "findings")
        .where(F.size("findings") > 0)
    )
    values = session_values(hits, session, sequence, order=order)
    vault = append_vault(values, existing) if existing is not None else build_vault(values)
    vault = checkpointed(vault)
    return mask_with_vault(docs, hits.select(key, session, "findings"), vault, key, session, text), vault
