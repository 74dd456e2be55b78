"""Encoders: ordinal codes, one-hot, token counts, column dictionary, design matrix.

Relational forms (dictionary tables, long-form matrix cells) are what the SQL oracle
checks; ``design_matrix`` assembles the same content into one ``pyspark.ml`` vector
column for model training.
"""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ctrkit.functions.tokens import tokens, word_tokens
from ctrkit.operators.ranking import ordered_scan
from ctrkit.operators.stats import by_factor, long_form
from ctrkit.session import scratch_path

# Executors need Arrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# An integer text: digits with or without a sign. '1.0', '1e1' and ' 1' are texts like any other.
INTEGER_TEXT = r"^[+-]?[0-9]+$"


def as_integer(value) -> Column:
    """The integer that a text is, or NULL; the one definition of a numeric value."""
    return F.when(value.rlike(INTEGER_TEXT), value.try_cast("bigint"))


def ordinal_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, val, code) with codes 0..n-1 per feature. A feature is numeric when each
    of its non-NULL values is an integer text; its codes follow the integers, and texts of the
    same integer ('1', '01') share a code. Other features are coded in text order. Both the
    flag and the codes come from the distinct values."""
    vals = long_form(df, cols, [], name_col="feature", value_col="val").where(F.col("val").isNotNull()).distinct()
    flags = vals.groupBy("feature").agg(F.bool_and(as_integer(F.col("val")).isNotNull()).alias("_numeric"))
    keyed = vals.join(flags, "feature").withColumn("_num", F.when(F.col("_numeric"), as_integer(F.col("val"))))
    keyed = keyed.withColumn("_key", F.coalesce(F.col("_num").cast("string"), F.col("val")))
    coded = ordered_scan(keyed.select("feature", "_num", "_key").distinct(),
                         [F.col("_num").asc_nulls_last(), F.col("_key").asc()], ["feature"], index_col="code")
    return keyed.join(coded.select("feature", "_key", "code"), ["feature", "_key"]).select("feature", "val", "code")


def ordinal_encode(df: DataFrame, cols: list[str], dictionary: DataFrame | None = None,
                   suffix: str = "_code") -> DataFrame:
    """Add ``<col>_code`` for each column (raw values are kept)."""
    dictionary = dictionary if dictionary is not None else ordinal_dictionary(df, cols)
    out = df
    for c in cols:
        d = dictionary.where(F.col("feature") == c).select(F.col("val").alias(c), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(d, c, "left")
    return out


def block_offsets(sizes: DataFrame, order: list[str], name_col: str = "feature", size_col: str = "n") -> DataFrame:
    """Column offset of each block (one row per feature, so the window is tiny)."""
    expr = None
    for i, f in enumerate(order):
        expr = F.when(F.col(name_col) == f, F.lit(i)) if expr is None else expr.when(F.col(name_col) == f, F.lit(i))
    w = Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("_pos", expr).withColumn("offset", F.coalesce(F.sum(size_col).over(w), F.lit(0)))
            .drop("_pos"))


def token_dictionary(df: DataFrame, fields: list[str], word: bool = False) -> DataFrame:
    """E3 vocabulary, alphabetical per field: (feature, val, code). The blank tokenizer
    keeps ``-1`` as a token; the word tokenizer keeps words of 2+ characters."""
    lf = long_form(df, fields, [], name_col="feature", value_col="_v").where(F.col("_v").isNotNull())
    toks = word_tokens("_v") if word else tokens(F.lower(F.col("_v")))
    vals = lf.select("feature", F.explode(toks).alias("val")).distinct()
    return ordered_scan(vals, [F.col("val").asc()], ["feature"], index_col="code").select("feature", "val", "code")


def feature_dictionary(df: DataFrame, onehot_cols: list[str], token_fields: list[str],
                       numeric_cols: list[str] = ()) -> DataFrame:
    """(feature, val, col_index) of every column of the assembled matrix: all one-hot classes
    in column order, then all token vocabularies, then one column per numeric (``val`` NULL)."""
    numeric = df.sparkSession.createDataFrame([(c, None, 0) for c in numeric_cols],
                                              "feature string, val string, code bigint")
    blocks = (ordinal_dictionary(df, onehot_cols).unionByName(token_dictionary(df, token_fields)).unionByName(numeric))
    sizes = blocks.groupBy("feature").agg((F.max("code") + 1).alias("n"))
    offs = block_offsets(sizes, [*onehot_cols, *token_fields, *numeric_cols])
    return blocks.join(F.broadcast(offs.select("feature", "offset")), "feature").select(
        "feature", "val", (F.col("offset") + F.col("code")).cast("bigint").alias("col_index"))


def one_hot_long(df: DataFrame, row_keys: list[str], cols: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """E2 in long form: (row_keys..., col_index, value=1.0), one cell per column per row,
    ``col_index`` = block offset + code."""
    dictionary = dictionary if dictionary is not None else ordinal_dictionary(df, cols)
    sizes = dictionary.groupBy("feature").agg((F.max("code") + 1).alias("n"))
    offs = block_offsets(sizes, cols)
    # Written, a column's classes have a size by which Spark broadcasts them: rows with few values are not brought together.
    d = by_factor(dictionary.join(F.broadcast(offs.select("feature", "offset")), "feature").select(
        "feature", "val", (F.col("offset") + F.col("code")).cast("bigint").alias("col_index")), "feature")
    rows = df.select(*row_keys, *[F.col(c).cast("string").alias(f"_v_{c}") for c in cols])
    for c in cols:
        one = d.where(F.col("feature") == c).select(F.col("val").alias(f"_v_{c}"), F.col("col_index").alias(f"_i_{c}"))
        rows = rows.join(one, f"_v_{c}", "left")
    return (rows.select(*row_keys, F.explode(F.array(*[f"_i_{c}" for c in cols])).alias("col_index"))
            .where(F.col("col_index").isNotNull()).select(*row_keys, "col_index", F.lit(1.0).alias("value")))


def token_counts_long(df: DataFrame, row_keys: list[str], fields: list[str], word: bool = False,
                      dictionary: DataFrame | None = None) -> DataFrame:
    """E3a / E3b in long form: (row_keys..., feature, code, count)."""
    dictionary = dictionary if dictionary is not None else token_dictionary(df, fields, word)
    lf = long_form(df, fields, list(row_keys), name_col="feature", value_col="_v").where(F.col("_v").isNotNull())
    toks = word_tokens("_v") if word else tokens(F.lower(F.col("_v")))
    ex = lf.select(*row_keys, "feature", F.explode(toks).alias("val"))
    counts = ex.groupBy(*row_keys, "feature", "val").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(dictionary, ["feature", "val"]).select(*row_keys, "feature", "code", "count")


def packed_strings(df: DataFrame, token_fields: list[str], dictionary: DataFrame) -> DataFrame:
    """(feature, val, cells): of every distinct string of the token fields its (column, count) cells, sorted by
    column. A string is split and counted once, whatever the number of rows that tell it."""
    strings = long_form(df, token_fields, [], name_col="feature", value_col="_v").where(F.col("_v").isNotNull()).distinct()
    counts = (strings.select("feature", "_v", F.explode(tokens(F.lower(F.col("_v")))).alias("val"))
              .groupBy("feature", "_v", "val").agg(F.count(F.lit(1)).cast("double").alias("value"))
              .join(dictionary, ["feature", "val"]))
    cell = F.struct(F.col("col_index").cast("int").alias("i"), F.col("value").alias("x"))
    return (counts.groupBy("feature", "_v").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
            .select("feature", F.col("_v").alias("val"), "cells"))


#: Tokens of a vocabulary up to which it is shipped to the tasks; with more, distinct strings are packed and looked up.
SHIPPED_TOKENS = 100_000


def packed_in_place(rows: DataFrame, fields: list[str], dictionary: DataFrame) -> DataFrame:
    """``rows`` with the column ``_p_<field>`` of the sorted (column, count) cells of the token strings ``_v_<field>``, which
    go; a row stays where it lies. A batch splits and counts each of its distinct strings once."""
    # As bounded by ``SHIPPED_TOKENS``.
    at: dict[str, dict[str, int]] = {c: {} for c in fields}
    for r in dictionary.where(F.col("feature").isin(fields)).collect():
        at[r["feature"]][r["val"]] = r["col_index"]
    cell = pa.list_(pa.struct([("i", pa.int32()), ("x", pa.float64())]))

    def packed(strings: pa.Array, column: dict[str, int]) -> pa.Array:
        coded = strings.dictionary_encode()
        i, x, ends = [], [], [0]
        for text in coded.dictionary.to_pylist():
            counts = sorted(Counter(column[t] for t in text.split(" ")).items())
            i.extend(k for k, _ in counts)
            x.extend(n for _, n in counts)
            ends.append(len(i))
        cells = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.float64())], ["i", "x"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells).take(coded.indices).cast(cell)

    lower = [F.lower(F.col(f"_v_{c}")).alias(f"_v_{c}") for c in fields]
    others = [c for c in rows.columns if c not in {f"_v_{c}" for c in fields}]
    rows = rows.select(*others, *lower)

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(packed(part.column(f"_v_{c}"), at[c]) for c in fields)],
                                                 names=[*others, *(f"_p_{c}" for c in fields)])

    cells = ArrayType(StructType([StructField("i", IntegerType()), StructField("x", DoubleType())]))
    return rows.mapInArrow(pack, StructType([*rows.select(*others).schema.fields, *(StructField(f"_p_{c}", cells) for c in fields)]))


def design_matrix(df: DataFrame, row_keys: list[str], onehot_cols: list[str], token_fields: list[str],
                  numeric_cols: list[str] = (), keep: list[str] = ("label",), output: str = "features"
                  ) -> tuple[DataFrame, DataFrame]:
    """One sparse vector per row = one-hot blocks, then token-count blocks, then raw numeric
    columns. Returns (row_keys..., keep..., ``features``), dictionary).

    A row never leaves its place: each of its values is looked up as the cell (one-hot) or turned into the packed
    cells (token string) that it stands for, and the pieces are concatenated in the order of the
    blocks, so nothing is exploded or gathered per row. The dictionary is stored with a partition per column,
    small ones are broadcast by their size, large ones joined by value. Token strings are packed in the
    tasks, by a vocabulary shipped to them; one of over ``SHIPPED_TOKENS`` tokens packs the distinct strings
    instead, which are joined by value. The result is written to the shared folder in the vector
    type's own layout and read back as vectors: no row is made dense."""
    spark = df.sparkSession
    dictionary = by_factor(feature_dictionary(df, onehot_cols, token_fields, numeric_cols), "feature")
    width = (dictionary.agg(F.max("col_index")).first()[0] or 0) + 1
    shipped = dictionary.where(F.col("feature").isin(list(token_fields))).count() <= SHIPPED_TOKENS
    strings = by_factor(packed_strings(df, token_fields, dictionary), "feature") if token_fields and not shipped else None
    # One entry per numeric column.
    at = {r["feature"]: r["col_index"] for r in dictionary.where(F.col("feature").isin(list(numeric_cols))).collect()} \
        if numeric_cols else {}
    rows = df.select(*row_keys, *[c for c in keep if c not in row_keys], *[F.col(c).cast("string").alias(f"_v_{c}")
                                                                           for c in [*onehot_cols, *token_fields]],
                     *[F.col(c).cast("double").alias(f"_x_{c}") for c in numeric_cols])
    for c in onehot_cols:
        one = dictionary.where(F.col("feature") == c).select(F.col("val").alias(f"_v_{c}"), F.col("col_index").cast("int").alias(f"_i_{c}"))
        rows = rows.join(one, f"_v_{c}", "left").drop(f"_v_{c}")
    for c in token_fields if not shipped else []:
        one = strings.where(F.col("feature") == c).select(F.col("val").alias(f"_v_{c}"), F.col("cells").alias(f"_p_{c}"))
        rows = rows.join(one, f"_v_{c}", "left")
    if token_fields and shipped:
        rows = packed_in_place(rows, list(token_fields), dictionary)

    def cell(i, x):
        return F.struct(i.cast("int").alias("i"), x.cast("double").alias("x"))

    none = F.array().cast("array<struct<i: int, x: double>>")
    hot = [cell(F.col(f"_i_{c}"), F.lit(1.0)) for c in onehot_cols]
    raw = [cell(F.lit(at[c]), F.col(f"_x_{c}")) for c in numeric_cols]
    cells = F.concat(F.filter(F.array(*hot), lambda c: c["i"].isNotNull()) if hot else none,
                     *[F.coalesce(F.col(f"_p_{c}"), none) for c in token_fields],
                     F.filter(F.array(*raw), lambda c: c["x"] != 0) if raw else none)
    return as_vectors(rows.withColumn("_c", cells), [*row_keys, *[c for c in keep if c not in row_keys]], width, output), dictionary


#: Rows of a file of vectors. Equal token strings make vectors many times as large as their files; a task reads at
#: most ``maxPartitionBytes`` / ``openCostInBytes`` files, 32 by default, so this bounds its vectors too.
VECTOR_ROWS = 20_000


def as_vectors(rows: DataFrame, cols: list[str], width: int, output: str) -> DataFrame:
    """``cols`` and the sparse vector of the sorted (column, value) cells in ``_c``, by way of a written table."""
    spark = rows.sparkSession
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"),
                      F.transform("_c", lambda c: c["i"]).alias("indices"), F.transform("_c", lambda c: c["x"]).alias("values"))
    path = scratch_path(spark, "vectors")
    rows.select(*cols, vector.alias(output)).write.option("maxRecordsPerFile", VECTOR_ROWS).parquet(path)
    schema = StructType([*rows.select(*cols).schema.fields, StructField(output, VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def vectors_of(cells: DataFrame, rows: DataFrame, row_keys: list[str], width: int | None = None,
               output: str = "features") -> DataFrame:
    """``rows`` with the sparse vector of their cells (row_keys..., col_index, value); rows without a
    cell have the empty vector. ``width`` defaults to the largest column plus one."""
    if width is None:
        width = (cells.agg(F.max("col_index")).first()[0] or 0) + 1
    cell = F.struct(F.col("col_index").cast("int").alias("i"), F.col("value").cast("double").alias("x"))
    packed = cells.groupBy(*row_keys).agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    full = rows.join(packed, list(row_keys), "left").withColumn(
        "_c", F.coalesce("_c", F.array().cast("array<struct<i: int, x: double>>")))
    return as_vectors(full, rows.columns, width, output)


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """The dictionary as a table; ``load_dictionary`` reads it back."""
    dictionary.write.mode("overwrite").parquet(path)


def load_dictionary(spark, path: str) -> DataFrame:
    return spark.read.schema("feature string, val string, col_index bigint").parquet(path)
