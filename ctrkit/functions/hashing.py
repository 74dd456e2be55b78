"""Reproducible hash buckets: the same row always lands in the same split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(cols: list[str], buckets: int = 100, salt: str | None = None) -> Column:
    """First 7 hex digits of md5(salt_key) as an integer, modulo ``buckets``."""
    parts = ([F.lit(salt)] if salt else []) + [F.col(c).cast("string") for c in cols]
    key = F.concat_ws("_", *parts)
    return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint") % F.lit(buckets)).cast("bigint")
