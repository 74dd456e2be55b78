"""Click / impression statistics over one, two or three keys, and their lookups.

The core is *long form*: many features are unpivoted into ``(factor_name, value)``
rows so that the statistics of every feature come out of ONE aggregation (one shuffle,
partial aggregation on the map side absorbs hot values such as the ``'-1'``
sentinel), instead of one job per feature.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.functions.tokens import SENTINEL, token_count, tokens
from ctrkit.session import num_partitions, scratch_path


def long_form(df: DataFrame, factors: list[str], ids: list[str], name_col: str = "factor_name",
              value_col: str = "value") -> DataFrame:
    """Unpivot feature columns into (ids..., factor_name, value); values as strings."""
    casted = df.select(*ids, *[F.col(f).cast("string").alias(f) for f in factors])
    return casted.unpivot(ids, factors, name_col, value_col)


def long_tokens(df: DataFrame, fields: list[str], ids: list[str], drop_sentinel: bool = True,
                name_col: str = "factor_name", token_col: str = "single_value") -> DataFrame:
    """Per-token long form ``(ids..., factor_name, single_value)`` of multi-valued fields."""
    lf = long_form(df, fields, ids, name_col, "_v")
    if drop_sentinel:
        lf = lf.where(F.col("_v") != SENTINEL)
    return lf.select(*ids, name_col, F.explode(tokens("_v")).alias(token_col))


def click_stats(df: DataFrame, keys: list[str], label: str = "label", clicks: str = "clicks",
                impressions: str = "impressions", ctr: str | None = "ctr") -> DataFrame:
    """Per key: clicks = sum(label), impressions = count(*), ctr = clicks / impressions.
    Rows without a label (test) are not counted."""
    out = (df.where(F.col(label).isNotNull()).groupBy(*keys)
           .agg(F.sum(label).cast("bigint").alias(clicks), F.count(F.lit(1)).alias(impressions)))
    if ctr:
        out = out.withColumn(ctr, F.col(clicks) / F.col(impressions))
    return out


def token_sums(df: DataFrame, fields: list[str], keys: list[str], sums: dict[str, str]) -> DataFrame:
    """(factor_name, single_value, keys..., sums...) over single tokens of multi-valued fields.

    Rows are first summed per whole string, which partial aggregation does before anything is
    exploded: a string told by many rows is split into its tokens once. ``sums`` names SQL
    aggregates of the rows; their sums over the strings of a token are what is returned."""
    whole = (long_form(df, fields, list(dict.fromkeys([*keys, *df_columns(sums, df)])), value_col="_v")
             .where(F.col("_v") != SENTINEL).groupBy("factor_name", "_v", *keys)
             .agg(*[F.expr(sql).alias(name) for name, sql in sums.items()]))
    return (whole.select("factor_name", *keys, *sums, F.explode(tokens("_v")).alias("single_value"))
            .groupBy("factor_name", "single_value", *keys)
            .agg(*[F.sum(name).cast("bigint").alias(name) for name in sums]))


def df_columns(sums: dict[str, str], df: DataFrame) -> list[str]:
    """Columns of ``df`` that the aggregates read."""
    return [c for c in df.columns if any(re.search(rf"\b{re.escape(c)}\b", sql) for sql in sums.values())]


def ctr_by_value(df: DataFrame, fields: list[str], label: str = "label") -> DataFrame:
    """A1: (factor_name, single_value, clicks, impressions, ctr) over single tokens."""
    out = token_sums(df.where(F.col(label).isNotNull()), fields, [],
                     {"clicks": f"sum({label})", "impressions": "count(1)"})
    return out.withColumn("ctr", F.col("clicks") / F.col("impressions"))


def ctr_by_value_aid(df: DataFrame, factors: list[str], key: str = "aid") -> DataFrame:
    """A2 for many factors at once: (factor_name, value, aid, clicks, impressions, ctr)."""
    if len(factors) > 1:
        stacks = [F.struct(F.lit(f).alias("factor_name"), F.col(f).cast("string").alias("value")) for f in factors]
        return placed_stats(df, stacks, ["factor_name", "value"], factors, [key])
    return click_stats(long_form(df, factors, [key, "label"]), ["factor_name", "value", key])


def placed_stats(df: DataFrame, stacks: list, keys: list[str], cols: list[str], shared: list[str], label: str = "label",
                 clicks: str = "clicks", impressions: str = "impressions", ctr: str = "ctr") -> DataFrame:
    """``click_stats`` of stacked keys that all hold the columns ``shared``: (keys..., shared..., clicks, impressions,
    ctr). ``stacks`` are structs of the keys over ``cols``. Rows are summed per combination of all columns, which
    bounds the rows of a hot key by its combinations, and brought together by ``shared``
    before they are stacked, so that the stacked rows, several for each, are summed where they lie."""
    whole = (df.where(F.col(label).isNotNull()).groupBy(*dict.fromkeys([*cols, *shared]))
             .agg(F.sum(label).cast("bigint").alias("_clicks"), F.count(F.lit(1)).alias("_rows")).repartition(*shared))
    out = (whole.select(*shared, "_clicks", "_rows", F.explode(F.array(*stacks)).alias("_x"))
           .select("_x.*", *shared, "_clicks", "_rows").groupBy(*keys, *shared)
           .agg(F.sum("_clicks").cast("bigint").alias(clicks), F.sum("_rows").cast("bigint").alias(impressions)))
    return out.withColumn(ctr, F.col(clicks) / F.col(impressions))


def click_ratio_by_label(df: DataFrame, fields: list[str]) -> DataFrame:
    """A3: share of each label among a token's rows:
    (factor_name, single_value, label, label_rows, value_rows, ratio). The window runs on
    the aggregated table (at most one row per label per token)."""
    per = token_sums(df.where(F.col("label").isNotNull()), fields, ["label"], {"label_rows": "count(1)"})
    w = Window.partitionBy("factor_name", "single_value")
    return per.withColumn("value_rows", F.sum("label_rows").over(w)).withColumn(
        "ratio", F.col("label_rows") / F.col("value_rows"))


def cross_ctr(df: DataFrame, combos: list[tuple[str, ...]], extra_keys: list[str] = ()) -> DataFrame:
    """A4 / A5: raw CTR of feature combinations in long form, all combinations in one
    aggregation: (cross_name, v1[, v2, ...], extra_keys..., feacnt, cnt, corr_ctr).
    Each combination's values are stacked as rows (an explode, not a join)."""
    width = max(len(c) for c in combos)
    structs = []
    for combo in combos:
        vals = [F.col(c).cast("string") for c in combo] + [F.lit(None).cast("string")] * (width - len(combo))
        structs.append(F.struct(F.lit("_".join(combo)).alias("cross_name"),
                                *[v.alias(f"v{i + 1}") for i, v in enumerate(vals)]))
    keys = ["cross_name"] + [f"v{i + 1}" for i in range(width)]
    cols = list(dict.fromkeys(c for combo in combos for c in combo))
    common = [c for c in cols if all(c in combo for combo in combos)]
    names = {"clicks": "feacnt", "impressions": "cnt", "ctr": "corr_ctr"}
    if len(combos) > 1 and common:
        named = df.select(*extra_keys, "label", *cols, *[F.col(c).cast("string").alias(f"_in_{c}") for c in common])
        out = placed_stats(named, structs, keys, cols, [*extra_keys, *[f"_in_{c}" for c in common]], **names)
        return out.select(*keys, *extra_keys, *names.values())
    stacked = (df.where(F.col("label").isNotNull())
               .select(*extra_keys, "label", F.explode(F.array(*structs)).alias("_x"))
               .select("_x.*", *extra_keys, "label"))
    return click_stats(stacked, keys + list(extra_keys), **names)


def with_token_counts(df: DataFrame, fields: list[str], suffix: str = "cnt") -> DataFrame:
    """F3 applied to fields: ``<field>cnt`` (-1 for the sentinel)."""
    return df.withColumns({f"{f}{suffix}": token_count(f) for f in fields})


def count_ctr_aid(df: DataFrame, field: str, key: str = "aid") -> DataFrame:
    """CTR by (token count of a field, aid)."""
    cnt = f"{field}cnt"
    return click_stats(with_token_counts(df, [field]), [cnt, key], clicks="feacnt", impressions="cnt",
                       ctr="corr_ctr")


def historic_ctr(df: DataFrame, key: str) -> DataFrame:
    """Mean label per key over labelled rows: (key, hist_ctr, hist_n)."""
    return (df.where(F.col("label").isNotNull()).groupBy(key)
            .agg(F.avg(F.col("label").cast("double")).alias("hist_ctr"), F.count(F.lit(1)).alias("hist_n")))


def delivery_volume(df: DataFrame, key: str = "aid") -> DataFrame:
    """How widely an ad was delivered (all instances, train and test)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("delivery"))


def lookup(df: DataFrame, stat: DataFrame, keys: list[str], fill: dict | None = None) -> DataFrame:
    """Left lookup by 1-3 keys; the stat must have one row per key so the row
    count is preserved. ``fill`` turns misses into a constant (J9)."""
    out = df.join(stat, keys, "left")
    if fill:
        out = out.fillna(fill)
    return out


def by_factor(stats: DataFrame, name_col: str = "factor_name") -> DataFrame:
    """The statistic as a table of the shared folder, one partition per factor: it is computed
    once, and a lookup of one factor reads that factor's files only. Rows are brought together
    by factor before they are written, so a factor has one file, or as many as its size asks for."""
    path = scratch_path(stats.sparkSession, f"stat-{name_col}")
    stats.hint("rebalance", name_col).write.partitionBy(name_col).parquet(path)
    return stats.sparkSession.read.schema(stats.schema).parquet(path)


def attach_long(df: DataFrame, row_keys: list[str], factors: list[str], stats: DataFrame,
                stat_col: str, match_keys: list[str] = ("aid",), suffix: str = "") -> DataFrame:
    """Attach a long-form statistic ``(factor_name, value, match_keys..., stat_col)``
    for many factors as one column per factor (``<factor><suffix>``).

    The statistic is written once, partitioned by factor; then one left equi-join per factor
    on its raw column. AQE picks the strategy per join from measured sizes: a small statistic
    is broadcast and the instance table is not shuffled at all; a large one is sort-merge
    joined with skew splitting of hot values."""
    table = by_factor(stats.select("factor_name", "value", *match_keys, stat_col))
    out = df.select(*dict.fromkeys(list(row_keys) + list(match_keys) + list(factors)))
    for f in factors:
        one = table.where(F.col("factor_name") == f).select(
            F.col("value").alias(f), *match_keys, F.col(stat_col).alias(f"_stat_{f}"))
        out = out.join(one, [f, *match_keys], "left")
    return out.select(*row_keys, *[F.col(f"_stat_{f}").alias(f"{f}{suffix}") for f in factors])


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """The rows as a table of the shared folder, hashed and sorted by ``keys`` into buckets. Tables of the same
    keys and buckets join without moving a row. ``placed`` rows lie by the keys already.
    ``drop_bucketed`` takes the table's name off the catalog."""
    spark = df.sparkSession
    n = buckets or num_partitions(spark)
    table = f"ctrkit_{name}_{uuid.uuid4().hex[:12]}"
    rows = df if placed else df.repartition(n, *keys)
    (rows.write.bucketBy(n, *keys).sortBy(*keys)
     .option("path", scratch_path(spark, f"bucketed-{name}")).saveAsTable(table))
    _BUCKETED.append(table)
    return spark.table(table)


_BUCKETED: list[str] = []
#: Bucketed statistics that one stage joins: bounds the sorters of a task.
LOOKUPS_AT_ONCE = 8


def drop_bucketed(spark) -> None:
    """Take the names of the bucketed tables off the catalog; their files go with ``drop_scratch``."""
    while _BUCKETED:
        spark.sql(f"DROP TABLE IF EXISTS {_BUCKETED.pop()}")


def attach_bucketed(rows: DataFrame, statistics: list[DataFrame], keys: list[str] = ("uid", "aid"),
                    buckets: int | None = None, at_once: int = LOOKUPS_AT_ONCE) -> DataFrame:
    """J6 many times: every statistic is a bucketed table of one row per key; its columns are attached to the
    rows, a bucketed table of the same keys. No side is shuffled, however many statistics there are.
    A task sorts its buckets of ``at_once`` statistics at a time; between, the rows are written,
    where they lie, as a bucketed table again."""
    keys = list(keys)
    out = rows
    for i, one in enumerate(statistics):
        if i and i % at_once == 0:
            out = bucketed(out, keys, "attached", buckets, placed=True)
        out = out.join(one, keys, "left")
    return out


#: Rows of one value that are brought together in a task; values with more are counted by an aggregate of their own.
HOT_ROWS = 2_000_000
#: Rows of a task that brings rows together by a value.
PLACED_ROWS = 250_000
#: Texts up to this length stay as they are; longer ones are looked up by a code.
SHORT_TEXT = 16
#: Rows of a statistic over two features up to which it is looked up as a table.
SMALL_TABLE = 100_000


def coded(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows with long texts of ``cols`` replaced by 64-bit codes, equal where and only where the texts are: a column
    of which two texts have one code stays as it is. NULL stays NULL."""
    texts = [c for c in cols if df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return df
    longest = df.agg(*[F.max(F.length(c)).alias(c) for c in texts]).first()
    for c in [c for c in texts if (longest[c] or 0) > SHORT_TEXT]:
        codes = df.select(c).where(F.col(c).isNotNull()).distinct().groupBy(F.xxhash64(c).alias("_code")).count()
        if codes.where("count > 1").isEmpty():
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.xxhash64(c)))
    return df


def with_shared(rows: DataFrame, source: DataFrame, place: str, others: list[str], sums: dict[str, Column],
                row_keys: list[str]) -> DataFrame:
    """``rows`` with the column ``_<other>_<name>`` for each other column and each aggregate of ``sums``, taken over the
    rows of ``source`` that share the values of (place, other); NULL where one of them is NULL.

    ``source`` has the rows of ``rows``. They are moved once, to where those of the same ``place`` lie, and each
    aggregate is a window there. A value of over ``HOT_ROWS`` rows is spread by the row's keys instead, and its
    aggregates, computed on their own, are looked up."""
    per = source.groupBy(place).agg(F.count(F.lit(1)).alias("_n"))
    total, hot = per.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > HOT_ROWS, F.col(place)))).first()
    is_hot = F.coalesce(F.col(place).isin(hot), F.lit(False)) | F.col(place).isNull() if hot else F.col(place).isNull()
    spread = F.when(is_hot, F.pmod(F.xxhash64(*row_keys), F.lit(1 << 16))).otherwise(F.lit(0))
    n = max(num_partitions(rows.sparkSession), (total or 0) // PLACED_ROWS + 1)
    out = rows.withColumn("_spread", spread).repartition(n, place, "_spread")
    for o in others:
        w = Window.partitionBy(place, "_spread", o)
        told = F.col(place).isNotNull() & F.col(o).isNotNull()
        out = out.withColumns({f"_{o}_{name}": F.when(told, agg.over(w)) for name, agg in sums.items()})
    for o in others if hot else []:
        path = scratch_path(rows.sparkSession, "hot")
        (source.where(F.col(place).isin(hot)).groupBy(F.col(place), F.col(o))
         .agg(*[agg.alias(f"_h_{name}") for name, agg in sums.items()]).write.parquet(path))
        out = out.join(rows.sparkSession.read.parquet(path), [place, o], "left").withColumns(
            {f"_{o}_{name}": F.when(is_hot, F.col(f"_h_{name}")).otherwise(F.col(f"_{o}_{name}")) for name in sums}).drop(
            *[f"_h_{name}" for name in sums])
    return out.drop("_spread")


def combination_count(df: DataFrame, factors: list[str], key: str = "aid",
                      row_keys: list[str] = ("uid", "aid")) -> DataFrame:
    """Number of instances sharing (factor value, aid), mapped back to each row as
    ``<factor>_<key>_cnt``. Every count holds the key, so the rows are moved once (``with_shared``)."""
    rows = coded(df.select(*dict.fromkeys([*row_keys, key, *factors])), [f for f in factors if f not in (*row_keys, key)])
    out = with_shared(rows, rows, key, factors, {"cnt": F.count(F.lit(1))}, list(row_keys))
    return out.select(*row_keys, *[F.col(f"_{f}_cnt").alias(f"{f}_{key}_cnt") for f in factors])


def pair_statistics(df: DataFrame, ad_features: list[str], user_features: list[str],
                    row_keys: list[str] = ("uid", "aid")) -> DataFrame:
    """A10: for every (ad feature, user feature) pair, co-occurrence count and CTR of the
    value pair, mapped back to the rows: columns ``<af>_<uf>_cnt`` and ``<af>_<uf>_ctr``.

    Pairs of features with few values come out of ONE stacked aggregation (partial aggregation collapses it on
    the map side), written once with a partition per pair and looked up with an equi-join each, which
    Spark broadcasts by its size. A user feature with many values has about as many pairs as there are rows:
    the rows are brought together by it once for all its pairs (``with_shared``), first of all."""
    rows, attach, wide = pair_lookups(df, ad_features, user_features, row_keys)
    for u in sorted(user_features, key=lambda u: u not in wide):
        rows = attach(rows, u).drop(*({u} - {*row_keys, *ad_features}))
    return rows.select(*row_keys, *[f"{a}_{u}_{x}" for a in ad_features for u in user_features for x in ("cnt", "ctr")])


def pair_tables(df: DataFrame, ad_features: list[str], user_features: list[str],
                row_keys: list[str] = ("uid", "aid")) -> tuple[DataFrame, list[DataFrame]]:
    """The statistics of ``pair_statistics`` as a bucketed table by the row's keys for each user feature, and the
    bucketed rows that they belong to. Rows of a feature with few values stay in their bucket."""
    rows, attach, wide = pair_lookups(df, ad_features, user_features, row_keys)
    keys = list(row_keys)
    rows = bucketed(rows, keys, "instances")
    tables = []
    for u in user_features:
        own = attach(rows.select(*dict.fromkeys([*keys, "label", *ad_features, u])), u)
        own = own.select(*keys, *[f"{a}_{u}_{x}" for a in ad_features for x in ("cnt", "ctr")])
        tables.append(bucketed(own, keys, u, placed=u not in wide))
    return rows.select(*keys), tables


def pair_lookups(df: DataFrame, ad_features: list[str], user_features: list[str],
                 row_keys: list[str]) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame], set[str]]:
    """(the rows with long texts coded, what attaches the pairs of a user feature to them, the features of many values).
    Which way a pair is looked up depends on its number of values, measured; the result does not."""
    used = list(dict.fromkeys([*ad_features, *user_features]))
    source = df.select(*dict.fromkeys([*row_keys, "label", *used]))
    sizes = source.agg(*[F.approx_count_distinct(c).alias(c) for c in used]).first()
    wide = {u for u in user_features if any((sizes[u] or 0) * (sizes[a] or 0) > SMALL_TABLE for a in ad_features)}
    source = coded(source, sorted(wide - {*row_keys, *ad_features}))
    pairs = [(a, u) for u in user_features if u not in wide for a in ad_features]
    structs = [F.struct(F.lit(f"{a}_{u}").alias("pair"), F.col(a).cast("string").alias("v1"),
                        F.col(u).cast("string").alias("v2")) for a, u in pairs]
    sums = {"cnt": F.count(F.lit(1)), "_clicks": F.sum("label"), "_impr": F.count("label")}
    ctr = F.try_divide(F.col("_clicks"), F.col("_impr").cast("double")).alias("ctr")
    stat = by_factor(
        source.select("label", F.explode(F.array(*structs)).alias("_p")).select("label", "_p.*").groupBy("pair", "v1", "v2")
        .agg(*[agg.alias(name) for name, agg in sums.items()]).select("pair", "v1", "v2", "cnt", ctr), "pair") if pairs else None

    def attach(rows: DataFrame, u: str) -> DataFrame:
        if u in wide:
            rows = with_shared(rows, source, u, ad_features, sums, list(row_keys))
            return rows.withColumns({f"{a}_{u}_cnt": F.col(f"_{a}_cnt") for a in ad_features} | {
                f"{a}_{u}_ctr": F.try_divide(F.col(f"_{a}__clicks"), F.col(f"_{a}__impr").cast("double"))
                for a in ad_features}).drop(*[f"_{a}_{name}" for a in ad_features for name in sums])
        for a in ad_features:
            one = stat.where(F.col("pair") == f"{a}_{u}").select(
                F.col("v1").alias(a), F.col("v2").alias(u), F.col("cnt").alias(f"{a}_{u}_cnt"), F.col("ctr").alias(f"{a}_{u}_ctr"))
            rows = rows.join(one, [a, u], "left")
        return rows

    return source, attach, wide


def noisy_or(token_rows: DataFrame, token_stat: DataFrame, group_keys: list[str], prob_col: str,
             out_col: str = "noisy_or") -> DataFrame:
    """Product over a row's tokens of a per-token probability (``1 - ctr``).
    ``token_rows`` = (group_keys..., factor_name, single_value); tokens without a
    statistic are skipped; a zero factor gives 0 (``product``, not exp(sum(ln)))."""
    j = token_rows.join(token_stat.select("factor_name", "single_value", prob_col),
                        ["factor_name", "single_value"], "left")
    return j.groupBy(*group_keys, "factor_name").agg(F.product(prob_col).alias(out_col))
