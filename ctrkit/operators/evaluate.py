"""Exact ROC AUC, ROC points, metric-curve arg-max and the CTR-proxy feature ranking.

AUC with ties counted 1/2 is computed from the score histogram:
    AUC = sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N)
``neg_below`` is a running sum over distinct scores, done with ``ordered_scan`` so
that no single task ever sorts the whole score table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.operators.keys import join_keys
from ctrkit.operators.ranking import ordered_scan


def score_histogram(df: DataFrame, score: str, label: str = "label", group_cols: list[str] = ()) -> DataFrame:
    """(group..., score, pos, neg) over rows with a label and a score."""
    lab = F.col(label).cast("bigint")
    return (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
            .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
            .agg(F.sum(lab).alias("pos"), F.sum(F.lit(1) - lab).alias("neg")))


def auc_exact(df: DataFrame, score: str, label: str = "label", group_cols: list[str] = ()) -> DataFrame:
    """(group..., auc, n_pos, n_neg); auc is NULL when a group has one class only."""
    return auc_from_counts(score_histogram(df, score, label, group_cols), "score", "pos", "neg", group_cols)


def auc_from_counts(counts: DataFrame, score: str, pos: str, neg: str, group_cols: list[str] = ()) -> DataFrame:
    """AUC from rows that already carry positive / negative counts per score (e.g. one
    row per statistic cell, all of whose instances share the cell's score)."""
    h = (counts.where(F.col(score).isNotNull())
         .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
         .agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg")))
    scanned = ordered_scan(h, [F.col("score").asc()], group_cols, sums=["neg"])
    return (scanned.groupBy(*group_cols)
            .agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_num"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
            .select(*group_cols,
                    F.try_divide(F.col("_num"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
                    "n_pos", "n_neg"))


def roc_points(df: DataFrame, score: str, label: str = "label", group_cols: list[str] = ()) -> DataFrame:
    """One point per distinct score used as threshold (score >= threshold is positive):
    (group..., threshold, fpr, tpr)."""
    h = score_histogram(df, score, label, group_cols)
    scanned = ordered_scan(h, [F.col("score").desc()], group_cols, sums=["pos", "neg"])
    totals = h.groupBy(*group_cols).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = join_keys(scanned, totals, list(group_cols))
    return j.select(*group_cols, F.col("score").alias("threshold"),
                    F.try_divide(F.col("neg_before") + F.col("neg"), F.col("_N").cast("double")).alias("fpr"),
                    F.try_divide(F.col("pos_before") + F.col("pos"), F.col("_P").cast("double")).alias("tpr"))


def best_round(curve: DataFrame, round_col: str = "round", metric_col: str = "metric",
               group_cols: list[str] = (), digits: int = 8) -> DataFrame:
    """Max of a metric curve (rounded) and the first round reaching it."""
    m = F.round(F.col(metric_col), digits)
    best = curve.groupBy(*group_cols).agg(F.max(m).alias("best_metric"))
    hit = join_keys(curve, best, list(group_cols))
    return (hit.where(m == F.col("best_metric")).groupBy(*group_cols)
            .agg(F.min(round_col).alias("best_round"), F.max("best_metric").alias("best_metric")))


def rank_by_metric(df: DataFrame, metric: str, name_col: str) -> DataFrame:
    """Rank a small per-feature table (one row per feature) by metric, ties by name."""
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(name_col))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))
