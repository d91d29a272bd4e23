"""Deterministic identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(c: Column) -> Column:
    """SHA-256 of the UTF-8 text (or bytes) as lower-case hex."""
    return F.sha2(c, 256)


def stable_id(*parts: Column) -> Column:
    """id derived from its key parts, so task retries and re-runs agree
    (Spark's ``uuid()`` would change on a retry)."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
