"""Projections, recodes and missing-value handling (all pure Column code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINEL = "-1"


def empty_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """``case when c = '' then null else c end`` over a column list."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def null_to_sentinel(df: DataFrame, cols: list[str] | None = None, sentinel: str = SENTINEL) -> DataFrame:
    """NULL -> ``'-1'``. ``cols=None`` fills every string column (the pandas form);
    a list fills only those (the SQL form, which passes ad columns through)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in cols})


def recode_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Negative code -1 -> 0; 1, 0 and NULL pass through."""
    return df.withColumn(col, F.when(F.col(col) == -1, F.lit(0)).otherwise(F.col(col)).cast("bigint"))


def split_labelled(df: DataFrame, col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(labelled rows, unlabelled rows)."""
    return df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def missing_rate(df: DataFrame, cols: list[str], sentinel: str = SENTINEL) -> DataFrame:
    """One pass: share of rows that are NULL or the sentinel, per column ->
    (column_name, missing_rate)."""
    aggs = [F.avg(F.when(F.col(c).isNull() | (F.col(c).cast("string") == sentinel), 1.0).otherwise(0.0)).alias(c)
            for c in cols]
    wide = df.agg(*aggs)
    return wide.unpivot([], cols, "column_name", "missing_rate")


def drop_high_missing(df: DataFrame, cols: list[str], threshold: float, sentinel: str = SENTINEL) -> DataFrame:
    """Drop columns whose missing rate exceeds ``threshold`` (one small aggregate row
    per column reaches the driver)."""
    rates = {r["column_name"]: r["missing_rate"] for r in missing_rate(df, cols, sentinel).collect()}
    return df.drop(*[c for c, r in rates.items() if r is not None and r > threshold])


def cast_keys(df: DataFrame, cols: list[str], to: str = "bigint") -> DataFrame:
    """``try_cast`` keys: text that is not a number becomes NULL instead of failing."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name (``marriageStatus`` -> ``marriagestatus``)."""
    return df.toDF(*[c.lower() for c in df.columns])


def sentinel_override(df: DataFrame, raw_col: str, stat_col: str, sentinel: str = SENTINEL,
                      value: float = -1.0) -> DataFrame:
    """Where the raw field is the missing marker, the statistic becomes ``value``."""
    return df.withColumn(stat_col, F.when(F.col(raw_col) == sentinel, F.lit(value))
                         .otherwise(F.col(stat_col)).cast("double"))


def scale_columns(df: DataFrame, cols: list[str], factor: float = 100.0) -> DataFrame:
    """Statistics multiplied on use (a rate as a percentage)."""
    return df.withColumns({c: (F.col(c) * F.lit(factor)).cast("double") for c in cols})
