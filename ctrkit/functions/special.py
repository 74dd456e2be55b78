"""Digamma and related Column expressions (no Spark built-in exists).

psi(x) is evaluated by the recurrence psi(x) = psi(x + K) - sum_{k<K} 1/(x + k)
followed by the asymptotic series at y = x + K >= K; with K = 8 the truncation
error is below 1e-12 for every x > 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8
# Bernoulli-series coefficients of the asymptotic expansion
# psi(y) ~ ln y - 1/(2y) - 1/(12y^2) + 1/(120y^4) - 1/(252y^6) + 1/(240y^8) - 1/(132y^10)
_SERIES = [(-1.0 / 12.0, 2), (1.0 / 120.0, 4), (-1.0 / 252.0, 6), (1.0 / 240.0, 8), (-1.0 / 132.0, 10)]


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def digamma(x) -> Column:
    x = _c(x).cast("double")
    y = x + F.lit(float(_SHIFT))
    inv2 = F.lit(1.0) / (y * y)
    series = F.log(y) - F.lit(0.5) / y
    p = F.lit(1.0)
    for coef, power in _SERIES:
        p = inv2 if power == 2 else p * inv2
        series = series + F.lit(coef) * p
    shift = F.lit(0.0)
    for k in range(_SHIFT):
        shift = shift + F.lit(1.0) / (x + F.lit(float(k)))
    return series - shift


def digamma_difference(n, a) -> Column:
    """psi(n + a) - psi(a); 0 when n = 0."""
    n, a = _c(n).cast("double"), _c(a).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(digamma(n + a) - digamma(a))


def digamma_np(x):
    """Same formula on numpy arrays (used inside executor-side fit loops)."""
    x = np.asarray(x, dtype="float64")
    y = x + _SHIFT
    inv2 = 1.0 / (y * y)
    out = np.log(y) - 0.5 / y
    p = np.ones_like(y)
    for coef, _ in _SERIES:
        p = p * inv2
        out = out + coef * p
    for k in range(_SHIFT):
        out = out - 1.0 / (x + k)
    return out
