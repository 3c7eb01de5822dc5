"""Salted hashes of redacted texts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def salted_hash(salt: bytes):
    """A column function: 32 bytes of BLAKE2b over salt and text."""

    @F.pandas_udf(T.BinaryType())
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b(salt + t.encode("utf-8", "surrogatepass"), digest_size=32).digest(), na_action="ignore")

    return hashed


def salted_sha256(text: Column, salt: bytes) -> Column:
    """The native alternative, for stores that are written by other engines too."""
    return F.unhex(F.sha2(F.concat(F.lit(salt), text.cast("binary")), 256))


def hash_prefix(digest: Column) -> Column:
    """The 16 hexadecimal digits that name a text in results; empty for null."""
    return F.coalesce(F.lower(F.substring(F.hex(digest), 1, 16)), F.lit(""))
