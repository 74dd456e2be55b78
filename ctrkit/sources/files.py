"""Delimited-text and table scans / sinks, partitioned statistic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ctrkit.functions.formatting import fixed_point

#: Rows of a compressed part file.
PART_ROWS = 1_000_000


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                   header: bool = False) -> DataFrame:
    """CSV with a declared schema (never inferred). With ``header=True``
    the first line is skipped and columns are taken by position from the schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", compression: str = "none") -> None:
    """Header or header-less CSV sink (one part file per partition, ``PART_ROWS`` rows at most if it is
    compressed: such a file is read by one task)."""
    writer = df.write.mode(mode).option("header", header).option("compression", compression)
    (writer if compression == "none" else writer.option("maxRecordsPerFile", PART_ROWS)).csv(path)


def export_select_csv(df: DataFrame, cols: list[str], path: str) -> None:
    """Fixed column list with a header line."""
    write_csv(df.select(*cols), path, header=True)


def create_table_as_select(spark: SparkSession, df: DataFrame, table: str, path: str) -> DataFrame:
    """``CREATE TABLE ... USING parquet LOCATION ... AS SELECT``; the table lives in
    a shared folder, not a machine-local warehouse."""
    view = f"{table}_src"
    df.createOrReplaceTempView(view)
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}' AS SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return spark.table(table)


def overwrite_table(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """The rows of an existing table replaced, its definition and place kept
    (``LOAD DATA ... OVERWRITE INTO TABLE``). Columns are matched by name."""
    df.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table, overwrite=True)
    return spark.table(table)


def write_partitioned(df: DataFrame, path: str, partition_col: str = "factor_name", fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """One folder per feature name."""
    df.write.mode(mode).format(fmt).partitionBy(partition_col).save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_col: str = "factor_name",
                         fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df``; the others survive
    (dynamic partition overwrite, set per write)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
     .partitionBy(partition_col).save(path))


def read_partition(spark: SparkSession, path: str, value: str, partition_col: str = "factor_name",
                   fmt: str = "parquet") -> DataFrame:
    """Partition-pruned read of one feature."""
    return spark.read.format(fmt).load(path).where(F.col(partition_col) == value)


def submission(df: DataFrame, score: str, keys: list[str] = ("aid", "uid"), digits: int = 8) -> DataFrame:
    """``aid,uid,score`` with the score as fixed-point text."""
    return df.select(*keys, fixed_point(score, digits).alias("score"))
