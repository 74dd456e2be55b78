"""Multi-valued field operators: explode, vocabulary, importance ranking, top-N cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrkit.functions.tokens import OTHER, SENTINEL, tokens
from ctrkit.operators.ranking import ordered_scan
from ctrkit.operators.stats import long_form, long_tokens, token_sums


def explode_tokens(df: DataFrame, fields: list[str], keys: list[str] = ("uid", "aid"),
                   drop_sentinel: bool = True) -> DataFrame:
    """per-token instance table (factor_name, keys..., single_value)."""
    out = long_tokens(df, fields, list(keys), drop_sentinel)
    return out.select("factor_name", *keys, "single_value")


def vocabulary(df: DataFrame, fields: list[str], lower: bool = False) -> DataFrame:
    """Distinct tokens per field (factor_name, token)."""
    lf = long_form(df, fields, [], value_col="_v").where(F.col("_v").isNotNull())
    v = F.lower(F.col("_v")) if lower else F.col("_v")
    return lf.select("factor_name", F.explode(tokens(v)).alias("token")).distinct()


def token_importance(df: DataFrame, fields: list[str], label: str = "label") -> DataFrame:
    """Importance per token = impressions on labelled rows: (factor_name, single_value,
    import_value). The sentinel is not a token here."""
    return token_sums(df.where(F.col(label).isNotNull()), fields, [], {"import_value": "count(1)"})


def rank_tokens(importance: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """rank 1.. per factor by importance desc, ties by token asc (the sentinel is never
    ranked). Distributed: a factor with millions of tokens is not sorted in one task."""
    imp = importance.where(F.col("single_value") != sentinel)
    ranked = ordered_scan(imp, [F.col("import_value").desc(), F.col("single_value").asc()], ["factor_name"],
                          index_col="_i")
    return ranked.withColumn("rank", F.col("_i") + F.lit(1)).drop("_i")


def _limit_col(top_n: dict[str, int] | int):
    if isinstance(top_n, int):
        return F.lit(top_n)
    expr = None
    for f, n in top_n.items():
        expr = F.when(F.col("factor_name") == f, F.lit(n)) if expr is None else expr.when(F.col("factor_name") == f, F.lit(n))
    return expr


def topn_cut_set(importance: DataFrame, top_n: dict[str, int] | int) -> DataFrame:
    """K1/K3: tokens ranked below N (rank > N) per factor: (factor_name, single_value,
    import_value, rank). N larger than the vocabulary cuts nothing."""
    return rank_tokens(importance).where(F.col("rank") > _limit_col(top_n))


def nth_value(importance: DataFrame, n: dict[str, int] | int) -> DataFrame:
    """K2: the value ranked N+1 (the first one cut), per factor."""
    return rank_tokens(importance).where(F.col("rank") == _limit_col(n) + F.lit(1))


def rank_counts(strings: DataFrame, field: str, ranked: DataFrame, top: int) -> DataFrame:
    """(field, counts): how many tokens of a string have rank 1, 2, ... ``top``, and how many any other
    rank or none. Every string is split once; ``cut_counts`` reads any smaller cut from it."""
    rank = F.least(F.coalesce("rank", F.lit(top + 1)), F.lit(top + 1)).cast("int")
    found = (strings.select(field, F.explode(tokens(field)).alias("single_value"))
             .join(ranked.select("single_value", "rank"), "single_value", "left")
             .groupBy(field).agg(F.collect_list(rank).alias("_r")))
    return found.select(field, F.transform(F.sequence(F.lit(1), F.lit(top + 1)), lambda k: F.size(
        F.filter("_r", lambda r: r == k)).cast("double")).alias("counts"))


def cut_counts(counts, top_n: int) -> Column:
    """The counts of the tokens ranked 1 to ``top_n`` and of all others together."""
    rest = F.aggregate(F.slice(counts, F.lit(top_n + 1), F.size(counts)), F.lit(0.0), lambda a, x: a + x)
    return F.concat(F.slice(counts, F.lit(1), F.lit(top_n)), F.array(rest))


def cut_tokens(df: DataFrame, key_cols: list[str], fields: list[str], cut_set: DataFrame,
               replacement: str = OTHER) -> DataFrame:
    """every token found in the cut set of its field becomes ``replacement``; NULL stays NULL.

    The cut set grows with the vocabulary, so it is joined, not collected. Only the distinct
    strings of a field are split, matched and put together again in order; rows get the new
    string by a join on the old one. ``key_cols`` come first in the result, then the other columns."""
    out = df
    for f in fields:
        strings = df.select(F.col(f).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        mine = cut_set.where(F.col("factor_name") == f).select(F.col("single_value").alias("_tok"), F.lit(True).alias("_cut")).distinct()
        marked = strings.select("_v", F.posexplode(tokens("_v")).alias("_pos", "_tok")).join(mine, "_tok", "left")
        piece = F.struct(F.col("_pos"), F.when(F.col("_cut"), F.lit(replacement)).otherwise(F.col("_tok")).alias("t"))
        new = marked.groupBy("_v").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), " ").alias("_new"))
        out = out.join(new.withColumnRenamed("_v", f), f, "left").withColumn(f, F.col("_new")).drop("_new")
    return out.select(*dict.fromkeys([*key_cols, *df.columns]))
