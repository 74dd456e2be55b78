"""Empirical-Bayes Beta-Binomial smoothing of click-through rates.

For cells with (clicks s, impressions t) the fixed point of Minka's iteration is

    alpha' = alpha * sum[psi(s + alpha) - psi(alpha)] / sum[psi(t + alpha + beta) - psi(alpha + beta)]
    beta'  = beta  * sum[psi(t - s + beta) - psi(beta)] / (same denominator)

The three sums separate, so Spark first reduces the cells of each factor to three marginal
histograms (how many cells have n clicks, n impressions without a click, n impressions);
their size is that of the distinct counts, not of the rows. Each fit then iterates on those.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrkit.functions import special
from ctrkit.functions.special import digamma_difference, digamma_np
from ctrkit.operators.keys import join_keys
from ctrkit.session import shared_root

# The grouped fit runs in Python workers; ship its code with the task (executors need
# no copy of this package installed).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(special)

# Fixed values of the reference fit: start point, iteration cap and tolerance.
ALPHA0, BETA0, MAX_ITER, EPSILON = 1.0, 1.0, 1000, 1e-8
#: Groups whose parameters are broadcast.
FEW_GROUPS = 100_000


def cell_histogram(stats: DataFrame, group_cols: list[str], clicks: str = "clicks",
                   impressions: str = "impressions") -> DataFrame:
    """(group..., clicks, impressions, n_cells)."""
    return (stats.groupBy(*group_cols, F.col(clicks).alias("clicks"), F.col(impressions).alias("impressions"))
            .agg(F.count(F.lit(1)).alias("n_cells")))


def beta_step(hist: DataFrame, params: DataFrame, group_cols: list[str]) -> DataFrame:
    """One fixed-point update for every group: (group..., alpha, beta, sum_a, sum_b, sum_m).
    The join strategy is left to Spark's measured sizes."""
    j = join_keys(hist, params.select(*group_cols, "alpha", "beta"), group_cols)
    n = F.col("n_cells")
    sums = j.groupBy(*group_cols).agg(
        F.max("alpha").alias("_a"), F.max("beta").alias("_b"),
        F.sum(n * digamma_difference(F.col("clicks"), F.col("alpha"))).alias("sum_a"),
        F.sum(n * digamma_difference(F.col("impressions") - F.col("clicks"), F.col("beta"))).alias("sum_b"),
        F.sum(n * digamma_difference(F.col("impressions"), F.col("alpha") + F.col("beta"))).alias("sum_m"))
    return sums.select(*group_cols,
                       (F.col("_a") * F.try_divide(F.col("sum_a"), F.col("sum_m"))).alias("alpha"),
                       (F.col("_b") * F.try_divide(F.col("sum_b"), F.col("sum_m"))).alias("beta"),
                       "sum_a", "sum_b", "sum_m")


def fit_beta_steps(stats: DataFrame, group_cols: list[str], steps: int, clicks: str = "clicks",
                   impressions: str = "impressions", alpha0: float = ALPHA0, beta0: float = BETA0) -> DataFrame:
    """Exactly ``steps`` updates from (alpha0, beta0), all on Spark:
    (group..., alpha, beta)."""
    hist = cell_histogram(stats, group_cols, clicks, impressions)
    params = hist.select(*group_cols).distinct().select(
        *group_cols, F.lit(float(alpha0)).alias("alpha"), F.lit(float(beta0)).alias("beta"))
    for _ in range(steps):
        params = beta_step(hist, params, group_cols).select(*group_cols, "alpha", "beta")
    return params


def marginal_histograms(stats: DataFrame, group_cols: list[str], clicks: str = "clicks",
                        impressions: str = "impressions", n_cells: str | None = None) -> DataFrame:
    """(group..., part, n, cells): how many cells of a group have n clicks ('s'), n impressions
    without a click ('f') and n impressions ('t'). The three sums of an update separate, so these
    three tables, linear in the distinct counts, hold all that a fit needs. A row of ``stats`` is a cell, or
    the number of cells in its column ``n_cells``."""
    s, t = F.col(clicks).cast("double"), F.col(impressions).cast("double")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), n.alias("n")) for p, n in (("s", s), ("f", t - s), ("t", t))])
    cells = F.col(n_cells) if n_cells else F.lit(1)
    return (stats.select(*group_cols, cells.cast("bigint").alias("_cells"), F.explode(parts).alias("_p"))
            .select(*group_cols, "_cells", "_p.*").groupBy(*group_cols, "part", "n").agg(F.sum("_cells").alias("cells")))


def _fit_histogram(parts: dict[str, tuple[np.ndarray, np.ndarray]], alpha: float, beta: float,
                   max_iter: int, eps: float):
    """Reference stopping rule: stop when both moves are below eps and keep the pair
    from before that last move. ``parts`` has (counts, cells) for 's', 'f' and 't'."""
    def total(part, a):
        n, cells = parts[part]
        return float((cells * (digamma_np(n + a) - digamma_np(a)) * (n > 0)).sum())

    n_iter, converged = 0, False
    for _ in range(max_iter):
        if not (alpha > 0 and beta > 0 and np.isfinite(alpha) and np.isfinite(beta)):
            return None, None, n_iter, False
        sa, sb, sm = total("s", alpha), total("f", beta), total("t", alpha + beta)
        if sm == 0.0:
            return None, None, n_iter, False
        new_a, new_b = alpha * sa / sm, beta * sb / sm
        if abs(new_a - alpha) < eps and abs(new_b - beta) < eps:
            converged = True
            break
        alpha, beta = new_a, new_b
        n_iter += 1
    if not (alpha > 0 and beta > 0):
        return None, None, n_iter, converged
    return alpha, beta, n_iter, converged


def fit_beta(stats: DataFrame, group_cols: list[str], clicks: str = "clicks", impressions: str = "impressions",
             max_iter: int = MAX_ITER, eps: float = EPSILON, alpha0: float = ALPHA0,
             beta0: float = BETA0, materialize: bool = False, n_cells: str | None = None) -> DataFrame:
    """Iterate to convergence per group on executors:
    (group..., alpha, beta, n_iter, converged). Group keys keep their types and may be NULL.
    Degenerate groups (no impressions, or a parameter driven to 0) give NULL alpha / beta;
    callers fall back to the raw CTR. With ``materialize`` the parameters are checkpointed, so
    that several later joins do not run the iteration again, and broadcast when they are counted to be few:
    rows joined by group would otherwise be dealt by group, one task each. ``n_cells``: see ``marginal_histograms``."""
    hist = marginal_histograms(stats, group_cols, clicks, impressions, n_cells)
    schema = ", ".join([*[f"{g} {stats.schema[g].dataType.simpleString()}" for g in group_cols],
                        "alpha double, beta double, n_iter int, converged boolean"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {p: (pdf.loc[pdf["part"] == p, "n"].to_numpy("float64"),
                     pdf.loc[pdf["part"] == p, "cells"].to_numpy("float64")) for p in "sft"}
        a, b, k, ok = _fit_histogram(parts, alpha0, beta0, max_iter, eps)
        row = {g: None if pd.isna(v) else v for g, v in zip(group_cols, key)}
        return pd.DataFrame([{**row, "alpha": a, "beta": b, "n_iter": k, "converged": ok}])

    fitted = hist.groupBy(*group_cols).applyInPandas(fit, schema)
    if materialize:
        shared_root(stats.sparkSession)
        fitted = fitted.checkpoint()
        if fitted.count() <= FEW_GROUPS:
            fitted = F.broadcast(fitted)
    return fitted


def smoothed_ratio(clicks: Column, impressions: Column, alpha: Column, beta: Column) -> Column:
    """B3 of one cell."""
    return F.try_divide(clicks + alpha, impressions + alpha + beta)


def smooth(stats: DataFrame, params: DataFrame, group_cols: list[str], clicks: str = "clicks",
           impressions: str = "impressions", complement: bool = False, out: str = "ctr",
           adjust_counts: bool = True) -> DataFrame:
    """Adjusted clicks = clicks + alpha, adjusted impressions = impressions +
    alpha + beta, ctr = ratio (or 1 - ratio). Groups without parameters keep the raw
    counts; the join strategy is left to Spark's measured sizes. With ``adjust_counts=False``
    the raw counts are kept and only ``out`` is added."""
    j = join_keys(stats, params.select(*group_cols, "alpha", "beta"), group_cols, "left")
    a = F.coalesce(F.col("alpha"), F.lit(0.0))
    b = F.coalesce(F.col("beta"), F.lit(0.0))
    ratio = smoothed_ratio(F.col(clicks), F.col(impressions), a, b)
    value = (F.lit(1.0) - ratio) if complement else ratio
    if not adjust_counts:
        return j.select(*[c for c in stats.columns if c != out], value.alias(out))
    keep = [c for c in stats.columns if c not in (clicks, impressions, out)]
    return j.select(*keep, (F.col(clicks) + a).alias(clicks), (F.col(impressions) + a + b).alias(impressions),
                    value.alias(out))


def fit_and_smooth(stats: DataFrame, group_cols: list[str], **smoothing) -> DataFrame:
    """The cells once: checkpointed, then fitted and smoothed from that one table."""
    shared_root(stats.sparkSession)
    cells = stats.checkpoint()
    return smooth(cells, fit_beta(cells, group_cols, materialize=True), group_cols, **smoothing)
