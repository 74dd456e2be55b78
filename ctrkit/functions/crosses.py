"""Pair and triple feature crosses built from columns already on the row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_cross(a: str, b: str, sep: str = " ") -> Column:
    """``"a b"`` from two columns."""
    return F.concat_ws(sep, F.col(a), F.col(b))


def combination(cols: list[str], sep: str = "_") -> Column:
    """Combination id of 2 or 3 keys, e.g. ``age_aid``; computed in place, no join."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def all_pairs(features: list[str]) -> list[tuple[str, str]]:
    """Unordered pairs (i < j) of a feature list."""
    return list(combinations(features, 2))


def all_pair_crosses(features: list[str], sep: str = " ") -> dict[str, Column]:
    return {f"{a}_{b}": pair_cross(a, b, sep) for a, b in all_pairs(features)}
