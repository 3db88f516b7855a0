"""Pseudonymous keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted_key(salt: str, *parts: Column) -> Column:
    """SHA-256 of the salt and the text of the parts, joined by a pipe."""
    if not salt:
        raise ValueError("a non-empty salt is required")
    return F.sha2(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]), 256)


def stable_order(key: Column, seed: int) -> Column:
    """Text whose order is a repeatable shuffle of the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hex_prefix(text: Column, digits: int = 3) -> Column:
    """Leading hex digits as a number: at most 16 ** digits buckets in key order."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("int")
