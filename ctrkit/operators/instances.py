"""Instance tables: star join, train/test union, splits and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.functions.hashing import hash_bucket
from ctrkit.session import num_partitions


def join_instances(inst: DataFrame, users: DataFrame, ads: DataFrame,
                   user_key: str = "uid", ad_key: str = "aid") -> DataFrame:
    """instances LEFT JOIN users ON uid LEFT JOIN ads ON aid. Instance keys are kept for
    unmatched rows; the join strategy (broadcast or shuffle) is left to Spark's size
    statistics. The ads, a few short columns, come first: rows that carry the long token strings of a
    user are not moved again."""
    out = inst.join(ads, ad_key, "left").join(users, user_key, "left")
    keys = dict.fromkeys([ad_key, user_key])
    return out.select(*dict.fromkeys([*keys, *inst.columns, *users.columns, *ads.columns]))


def union_marked(train: DataFrame, test: DataFrame, label: str = "label", marker=-2) -> DataFrame:
    """UNION ALL of train and test; test rows carry the marker label."""
    return train.unionByName(test.withColumn(label, F.lit(marker).cast(train.schema[label].dataType)))


def union_sources(frames: dict, col: str = "qubie") -> DataFrame:
    """Row concat by column name with an origin flag per input."""
    out = None
    for flag, df in frames.items():
        tagged = df.withColumn(col, F.lit(flag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


#: Rows of a side that one task puts next to the other's.
CONCAT_ROWS = 500_000


def column_concat(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of both sides next to each other, row by row. Rows are aligned by their keys, which may be
    NULL, not by position; the job fails if a row of either side has no partner or if a key is
    told twice, so a result has exactly the rows that both sides have."""
    mine, theirs = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    both = (left.withColumns({"_left": F.lit(1), "_right": F.lit(0)})
            .unionByName(right.withColumns({"_left": F.lit(0), "_right": F.lit(1)}), allowMissingColumns=True))
    # Brought together first, as a task can hold: nearly every key is one row of each side, and counting them where
    # they lie would hold all of a task's rows.
    n = max(num_partitions(left.sparkSession), right.count() // CONCAT_ROWS + 1)
    rows = both.repartition(n, *keys).groupBy(*keys).agg(
        F.sum("_left").alias("_left"), F.sum("_right").alias("_right"),
        *[F.any_value(c, True).alias(c) for c in [*mine, *theirs]])
    sure = F.when((F.col("_left") == 1) & (F.col("_right") == 1), F.lit(True)).otherwise(
        F.raise_error(F.lit("column_concat: the sides do not have the same rows")))
    return rows.where(sure).select(*left.columns, *theirs)


def hash_split(df: DataFrame, key_cols: list[str], train_share: int = 70, salt: str | None = None,
               col: str = "split") -> DataFrame:
    """Reproducible split: bucket(md5(key)) < share -> 'train' else 'valid'."""
    return df.withColumn(col, F.when(hash_bucket(key_cols, 100, salt) < train_share, F.lit("train"))
                         .otherwise(F.lit("valid")))


def cascaded_split(df: DataFrame, key_cols: list[str], sample_share: int = 20, train_share: int = 70,
                   sample_salt: str = "sample", split_salt: str = "split") -> DataFrame:
    """Subsample by one hash, then split the sample by a second, independent hash."""
    sampled = df.where(hash_bucket(key_cols, 100, sample_salt) < sample_share)
    return hash_split(sampled, key_cols, train_share, split_salt)


def balanced_weights(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    """``class_weight='balanced'``: n / (n_classes * n_class) per row. The class table
    has one row per class, so it is broadcast."""
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))
    every = Window.partitionBy(F.lit(1))
    per_class = per_class.select(
        label, (F.sum("_n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n_class"))).alias(col))
    return df.join(F.broadcast(per_class), label, "left")
