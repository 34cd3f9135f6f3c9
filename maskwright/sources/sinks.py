"""Writers for masked texts, restored texts and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .vaults import seal_vault


def write_masked(df: DataFrame, path: str, keys: list[str], by_ext: bool = True, mode: str = "errorifexists") -> None:
    """SNK-1: masked texts keyed by input; findings and vault stay out of the file."""
    writer = df.select(*keys, "masked").write.mode(mode)
    if by_ext and "ext" in keys:
        writer = writer.partitionBy("ext")
    writer.parquet(path)


def write_restored(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """SNK-3."""
    df.select(*keys, "restored").write.mode(mode).parquet(path)


def write_findings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-4: findings rows of any of the scans."""
    df.write.mode(mode).parquet(path)


def write_vault(vault: DataFrame, path: str, secret: Column, mode: str = "errorifexists") -> None:
    """SNK-2: encrypted vault; plain values never reach the disk."""
    seal_vault(vault, secret).write.mode(mode).parquet(path)
