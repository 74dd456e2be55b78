"""Semi-structured user-profile records: ``key v v|key v ...`` per line.

Each ``|``-separated piece is a key followed by its values; the first blank splits the
key from the values, the values keep their blanks. A key that is absent yields ``''``;
a repeated key keeps its last value; unknown keys are ignored (and counted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 24 fields of a user profile record, in the record header's spelling.
PROFILE_KEYS = ["uid", "age", "gender", "marriageStatus", "education", "consumptionAbility", "LBS",
                "interest1", "interest2", "interest3", "interest4", "interest5", "kw1", "kw2", "kw3",
                "topic1", "topic2", "topic3", "appIdInstall", "appIdAction", "ct", "os", "carrier", "house"]


def _entries(value: Column) -> Column:
    pieces = F.split(F.trim(value), r"\|")
    return F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, " ", 1).alias("k"),
        F.when(F.instr(p, " ") > 0, F.substr(p, F.instr(p, " ") + F.lit(1))).otherwise(F.lit("")).alias("v")))


def parse_profiles(lines: DataFrame, keys: list[str] = PROFILE_KEYS, value_col: str = "value",
                   count_unknown: bool = False) -> DataFrame:
    """One row per line, one string column per key (``uid`` as bigint)."""
    e = lines.select(_entries(F.col(value_col)).alias("_e"))
    cols = []
    for k in keys:
        v = F.try_element_at(F.filter(F.col("_e"), lambda x: x["k"] == F.lit(k)), F.lit(-1))["v"]
        v = F.coalesce(v, F.lit(""))
        cols.append((v.try_cast("bigint") if k == "uid" else v).alias(k))
    if count_unknown:
        known = F.array(*[F.lit(k) for k in keys])
        cols.append(F.size(F.filter(F.col("_e"), lambda x: ~F.array_contains(known, x["k"]))).alias("n_unknown_keys"))
    return e.select(*cols)


def read_profiles(spark: SparkSession, path: str, keys: list[str] = PROFILE_KEYS) -> DataFrame:
    """Text scan + parse; input splits replace the reference's chunked reader."""
    return parse_profiles(spark.read.text(path), keys)


def to_profile_lines(df: DataFrame, key_names: dict[str, str] | None = None) -> DataFrame:
    """Inverse: one ``value`` line per row, empty fields omitted."""
    key_names = key_names or {}
    pieces = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""),
                     F.concat(F.lit(key_names.get(c, c) + " "), F.col(c).cast("string"))) for c in df.columns]
    return df.select(F.concat_ws("|", *pieces).alias("value"))
