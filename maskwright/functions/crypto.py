"""Vault encryption with the built-in AES-GCM functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def vault_key(secret: Column, vault_name: Column) -> Column:
    """ENC-1: SHA-256 over secret and vault name; a renamed vault has another key."""
    return F.unhex(F.sha2(F.concat_ws("::", secret, vault_name), 256))


def seal(plain: Column, key: Column) -> Column:
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    """Plain text; a wrong key fails the query."""
    plain = F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
    return F.coalesce(plain, F.raise_error(F.lit("vault cannot be decrypted")).cast("string"))
