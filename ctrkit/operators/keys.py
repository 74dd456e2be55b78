"""Joins on group keys that may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the left side's key columns stay.
    Without keys ``right`` must be a single row, whose values are attached as literals."""
    if not keys:
        row = right.first()
        return left.select("*", *[F.lit(row[c] if row else None).cast(right.schema[c].dataType).alias(c)
                                  for c in right.columns])
    named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_key_{k}" for k in keys])
