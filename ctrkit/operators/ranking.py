"""Exact ordered scans without a single-task window.

``row_number() over (partition by p order by o)`` and running sums are the natural way
to write ranks, dictionary codes, top-N cuts and AUC, but a window whose partition is
the whole table (or one hot key) runs in one task. ``ordered_scan`` computes the same
values in three distributed steps:

1. range-partition the rows by (p, o) so every task holds a contiguous slice
   (equal keys stay together) and pin the slice id with ``spark_partition_id``;
2. number / sum inside each slice with a window partitioned by the slice id;
3. add per-(p, slice) offsets computed from a table with one row per slice.

The partitioned rows are checkpointed into the session's shared checkpoint folder so
that a retried task sees exactly the slices the offsets were computed from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.operators.keys import join_keys
from ctrkit.session import num_partitions, shared_root


def ordered_scan(df: DataFrame, order_cols: list[Column], partition_cols: list[str] | tuple = (),
                 sums: list[str] | tuple = (), index_col: str | None = None,
                 num_slices: int | None = None, stable: bool = True) -> DataFrame:
    """Add ``index_col`` (0-based row number within ``partition_cols`` in ``order_cols``
    order) and, for every column ``s`` in ``sums``, ``s + '_before'`` = sum of ``s``
    over the rows strictly before the row. ``order_cols`` must be a total order within
    each partition for the index to be deterministic."""
    spark = df.sparkSession
    n = num_slices or num_partitions(spark)
    part = list(partition_cols)
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in part], *order_cols)
              .withColumn("_slice", F.spark_partition_id()))
    if stable:
        shared_root(spark)
        ranged = ranged.checkpoint(eager=True)

    w = Window.partitionBy("_slice", *part).orderBy(*order_cols)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged
    if index_col:
        local = local.withColumn("_local_idx", F.row_number().over(w) - F.lit(1))
    for s in sums:
        local = local.withColumn(f"_local_{s}", F.coalesce(F.sum(s).over(before), F.lit(0)))

    totals = ranged.groupBy(*part, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    wo = (Window.partitionBy(*part) if part else Window).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_slice",
        F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_t_{s}").over(wo), F.lit(0)).alias(f"_off_{s}") for s in sums])

    out = join_keys(local, offsets, [*part, "_slice"])
    if index_col:
        out = out.withColumn(index_col, (F.col("_off_n") + F.col("_local_idx")).cast("bigint"))
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_off_{s}") + F.col(f"_local_{s}"))
    drop = ["_slice", "_off_n", "_local_idx"] + [f"_off_{s}" for s in sums] + [f"_local_{s}" for s in sums]
    return out.drop(*[c for c in drop if c in out.columns])

