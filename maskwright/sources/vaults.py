"""Encrypted vault tables (SNK-2, SRC-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.crypto import seal, unseal, vault_key
from ..operators.restore import TOKEN

# Entries per sealed row, so that a large session never becomes one JSON string.
SEALED_ENTRIES = 10_000
JSON_SHAPE = "map<string,struct<value:string,type:string>>"


def vault_map(entries: Column) -> Column:
    """VLT-5: ``placeholder -> (value, type)`` from an array of (seq, placeholder, value, label)."""
    return F.map_from_entries(F.transform(F.sort_array(entries), lambda e: F.struct(
        e["placeholder"], F.struct(e["value"].alias("value"), e["label"].alias("type"))
    )))


def map_entries(vault: Column) -> Column:
    """VLT-5 back: (placeholder, label, n, value) in insertion order."""
    return F.transform(F.map_entries(vault), lambda e: F.struct(
        e["key"].alias("placeholder"), e["value"]["type"].alias("label"),
        F.regexp_extract(e["key"], TOKEN, 2).cast("long").alias("n"),
        e["value"]["value"].alias("value"),
    ))


def seal_vault(vault: DataFrame, secret: Column, vault_name: Column | None = None) -> DataFrame:
    """Vault rows to encrypted JSON, in pieces of ``SEALED_ENTRIES`` entries per session."""
    name = vault_name if vault_name is not None else F.concat(
        F.lit("session-"), F.col("session_id").cast("string"), F.lit(".vault")
    )
    pieces = (
        vault.withColumn("piece", F.floor((F.col("seq") - 1) / SEALED_ENTRIES).cast("int"))
        .groupBy("session_id", "piece")
        .agg(F.collect_list(F.struct("seq", "placeholder", "value", "label")).alias("_entries"))
    )
    return pieces.withColumn("vault_name", name).select(
        "session_id", "vault_name", "piece",
        seal(F.to_json(vault_map(F.col("_entries"))), vault_key(secret, F.col("vault_name"))).alias("payload"),
    )


def open_vault(sealed: DataFrame, secret: Column) -> DataFrame:
    """Encrypted pieces back to vault rows; a wrong secret or a renamed vault fails."""
    plain = unseal(F.col("payload"), vault_key(secret, F.col("vault_name")))
    entries = map_entries(F.from_json(plain, JSON_SHAPE))
    e = F.col("_e")
    return (
        sealed.select("session_id", "piece", F.posexplode_outer(entries).alias("_pos", "_e"))
        .where(F.col("_pos").isNotNull())
        .select(
            "session_id", e["placeholder"].alias("placeholder"), e["label"].alias("label"),
            e["n"].alias("n"), e["value"].alias("value"),
            (F.col("piece").cast("long") * SEALED_ENTRIES + F.col("_pos") + 1).alias("seq"),
        )
    )
