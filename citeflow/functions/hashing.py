"""Seeded hash order: the same rows in any engine, at any partitioning, after any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, key: Column | str) -> Column:
    """Hex digest of ``seed|key``; sorting by it is a reproducible shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_slot(digest: Column, slots: Column) -> Column:
    """Cut the digest range into ``slots`` equal ranges and number them from 0 in digest order."""
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(head * slots / F.lit(2**32)).cast("int")
