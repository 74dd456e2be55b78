"""Statistics (A*), lookups (J*) and empirical-Bayes smoothing (B*, F11) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctrkit.functions.special import digamma_difference
from ctrkit.functions.tokens import token_count
from ctrkit.operators import clean, instances
from ctrkit.operators import stats as st
from ctrkit.operators.smoothing import beta_step, cell_histogram, fit_and_smooth, fit_beta, fit_beta_steps
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import (converged_fit_ctes, digamma_diff_sql, fit_converged_ctes, fit_steps_ctes,
                                     unpivot_sql, with_base)

FIT_STEPS = 5


def r6(c):
    return F.round(c, 6)


def _tok_sql(source: str, ids: list[str], fields: list[str]) -> str:
    idl = ", ".join(ids)
    return "\nUNION ALL\n".join(
        f"SELECT {idl}, '{f}' AS factor_name, unnest(string_split({f}, ' ')) AS single_value "
        f"FROM {source} WHERE {f} <> '-1'" for f in fields)


LAB_LONG = f"lab_long AS ({unpivot_sql('lab', ['uid', 'aid', 'label'], S.CROSS_FACTORS)})"
DATA_LONG = f"data_long AS ({unpivot_sql('data', ['uid', 'aid'], S.CROSS_FACTORS)})"
CELLS = ("cells AS (SELECT factor_name, value, aid, CAST(sum(label) AS BIGINT) AS clicks, "
         "count(*) AS impressions FROM lab_long GROUP BY factor_name, value, aid)")
LAB_TOK = f"lab_tok AS ({_tok_sql('lab', ['uid', 'aid', 'label'], S.TOKEN_FACTORS)})"
TOK_CELLS = ("tok_cells AS (SELECT factor_name, single_value, CAST(sum(label) AS BIGINT) AS clicks, "
             "count(*) AS impressions FROM lab_tok GROUP BY factor_name, single_value)")


def _cnt_sql(f: str) -> str:
    return f"CAST(CASE WHEN {f} = '-1' THEN -1 ELSE len(string_split({f}, ' ')) END AS BIGINT)"


# ----------------------------------------------------------------------------- A1-A3
@register("ctr_by_value", with_base(LAB_TOK, TOK_CELLS, select=(
    "SELECT factor_name, single_value, clicks, impressions, round(clicks / impressions, 6) AS ctr FROM tok_cells")))
def ctr_by_value(spark, d):
    out = st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS)
    return out.withColumn("ctr", r6(F.col("ctr")))


@register("ctr_by_value_aid", with_base(LAB_LONG, CELLS, select=(
    "SELECT factor_name, value, aid, clicks, impressions, round(clicks / impressions, 6) AS ctr FROM cells")))
def ctr_by_value_aid(spark, d):
    return st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS).withColumn("ctr", r6(F.col("ctr")))


@register("click_ratio_by_label", with_base(LAB_TOK, select=(
    "SELECT factor_name, single_value, label, label_rows, value_rows, round(label_rows / value_rows, 6) AS ratio "
    "FROM (SELECT factor_name, single_value, label, label_rows, "
    "CAST(sum(label_rows) OVER (PARTITION BY factor_name, single_value) AS BIGINT) AS value_rows FROM "
    "(SELECT factor_name, single_value, label, count(*) AS label_rows FROM lab_tok "
    "GROUP BY factor_name, single_value, label))")))
def click_ratio_by_label(spark, d):
    out = st.click_ratio_by_label(S.labelled(spark, d), S.TOKEN_FACTORS)
    return out.withColumn("value_rows", F.col("value_rows").cast("bigint")).withColumn("ratio", r6(F.col("ratio")))


# ----------------------------------------------------------------------------- A4-A6
CROSS2 = [("lbs", "aid"), ("carrier", "advertiserid"), ("lbs", "producttype"), ("consumptionability", "creativesize")]


def _cross_sql(combos, source="lab", width=None):
    width = width or max(len(c) for c in combos)
    parts = []
    for c in combos:
        vs = [f"CAST({x} AS VARCHAR) AS v{i + 1}" for i, x in enumerate(c)]
        vs += [f"CAST(NULL AS VARCHAR) AS v{i + 1}" for i in range(len(c), width)]
        parts.append(f"SELECT '{'_'.join(c)}' AS cross_name, {', '.join(vs)}, label FROM {source}")
    vcols = ", ".join(f"v{i + 1}" for i in range(width))
    return (f"SELECT cross_name, {vcols}, CAST(sum(label) AS BIGINT) AS feacnt, count(*) AS cnt, "
            f"round(sum(label) / count(*), 6) AS corr_ctr FROM ({' UNION ALL '.join(parts)}) "
            f"GROUP BY cross_name, {vcols}")


@register("cross_ctr_2", with_base(select=_cross_sql(CROSS2)))
def cross_ctr_2(spark, d):
    return st.cross_ctr(S.labelled(spark, d), CROSS2).withColumn("corr_ctr", r6(F.col("corr_ctr")))


CROSS3 = [(s, f, "aid") for s in ["lbs", "house", "carrier", "consumptionability"] for f in ["kw1cnt", "interest1cnt"]]


@register("cross_ctr_3", with_base(
    f"labc AS (SELECT *, {_cnt_sql('kw1')} AS kw1cnt, {_cnt_sql('interest1')} AS interest1cnt FROM lab)",
    select=_cross_sql(CROSS3, "labc")))
def cross_ctr_3(spark, d):
    lab = st.with_token_counts(S.labelled(spark, d), ["kw1", "interest1"])
    return st.cross_ctr(lab, CROSS3).withColumn("corr_ctr", r6(F.col("corr_ctr")))


@register("count_ctr_aid", with_base(select=(
    f"SELECT kw1cnt, aid, CAST(sum(label) AS BIGINT) AS feacnt, count(*) AS cnt, round(sum(label) / count(*), 6) "
    f"AS corr_ctr FROM (SELECT {_cnt_sql('kw1')} AS kw1cnt, aid, label FROM lab) GROUP BY kw1cnt, aid")))
def count_ctr_aid(spark, d):
    return st.count_ctr_aid(S.labelled(spark, d), "kw1").withColumn("corr_ctr", r6(F.col("corr_ctr")))


# ----------------------------------------------------------------------------- A7-A10
@register("historic_ctr", with_base(
    "h AS (SELECT aid, avg(CAST(label AS DOUBLE)) AS hist_ctr, count(*) AS hist_n FROM lab GROUP BY aid)",
    select="SELECT d.uid, d.aid, round(h.hist_ctr, 6) AS hist_ctr, h.hist_n FROM data d LEFT JOIN h ON d.aid = h.aid"))
def historic_ctr(spark, d):
    data = S.data_all(spark, d)
    h = st.historic_ctr(data, "aid")
    return st.lookup(data.select("uid", "aid"), h, ["aid"]).withColumn("hist_ctr", r6(F.col("hist_ctr")))


@register("ad_delivery_volume", with_base(select="SELECT aid, count(*) AS delivery FROM data GROUP BY aid"))
def ad_delivery_volume(spark, d):
    return st.delivery_volume(S.data_all(spark, d), "aid")


COMBO_FACTORS = S.USER_COLS


@register("combination_count", with_base(
    *[f"c_{f} AS (SELECT {f}, aid, count(*) AS n FROM data GROUP BY {f}, aid)" for f in COMBO_FACTORS],
    select="SELECT d.uid, d.aid, " + ", ".join(f"c_{f}.n AS {f}_aid_cnt" for f in COMBO_FACTORS) + " FROM data d " +
           " ".join(f"LEFT JOIN c_{f} ON d.{f} = c_{f}.{f} AND d.aid = c_{f}.aid" for f in COMBO_FACTORS)))
def combination_count(spark, d):
    return st.combination_count(S.data_all(spark, d), COMBO_FACTORS, "aid")


PAIR_AD = S.AD_COLS
PAIR_USER = S.USER_COLS


def _pair_sql():
    ctes, cols, joins = [], [], []
    for a in PAIR_AD:
        for u in PAIR_USER:
            n = f"{a}_{u}"
            ctes.append(f"p_{n} AS (SELECT {a}, {u}, count(*) AS cnt, sum(label) / count(label) AS ctr "
                        f"FROM data GROUP BY {a}, {u})")
            cols.append(f"p_{n}.cnt AS {n}_cnt, round(p_{n}.ctr, 6) AS {n}_ctr")
            joins.append(f"LEFT JOIN p_{n} ON d.{a} = p_{n}.{a} AND d.{u} = p_{n}.{u}")
    return with_base(*ctes, select="SELECT d.uid, d.aid, " + ", ".join(cols) + " FROM data d " + " ".join(joins))


@register("pair_statistics", _pair_sql())
def pair_statistics(spark, d):
    out = st.pair_statistics(S.data_all(spark, d), PAIR_AD, PAIR_USER)
    return out.select("uid", "aid", *[F.col(c) if c.endswith("_cnt") else r6(F.col(c)).alias(c)
                                      for c in out.columns if c not in ("uid", "aid")])


# ----------------------------------------------------------------------------- J2-J9, A17
def _raw_ctr(lab, f, key="aid"):
    x = st.cross_ctr(lab, [(f, key)]).select(F.col("v1").alias(f), F.col("v2").cast("bigint").alias(key),
                                            "corr_ctr")
    return x


@register("lookup_aid", with_base(
    "v AS (SELECT aid, count(*) AS delivery FROM data GROUP BY aid)",
    select="SELECT d.uid, d.aid, v.delivery FROM data d LEFT JOIN v ON d.aid = v.aid"))
def lookup_aid(spark, d):
    data = S.data_all(spark, d)
    return st.lookup(data.select("uid", "aid"), st.delivery_volume(data), ["aid"])


@register("lookup_feature_aid", with_base(
    "x AS (SELECT lbs, aid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY lbs, aid)",
    select="SELECT d.uid, d.aid, d.lbs, round(x.corr_ctr, 6) AS corr_ctr FROM data d "
           "LEFT JOIN x ON d.lbs = x.lbs AND d.aid = x.aid"))
def lookup_feature_aid(spark, d):
    data = S.data_all(spark, d)
    x = _raw_ctr(data, "lbs")
    return st.lookup(data.select("uid", "aid", "lbs"), x, ["lbs", "aid"]).withColumn("corr_ctr", r6(F.col("corr_ctr")))


@register("lookup_feature_adfeature", with_base(
    "x AS (SELECT carrier, advertiserid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY carrier, advertiserid)",
    select="SELECT d.uid, d.aid, round(x.corr_ctr, 6) AS corr_ctr FROM data d "
           "LEFT JOIN x ON d.carrier = x.carrier AND d.advertiserid = x.advertiserid"))
def lookup_feature_adfeature(spark, d):
    data = S.data_all(spark, d)
    x = st.cross_ctr(data, [("carrier", "advertiserid")]).select(
        F.col("v1").alias("carrier"), F.col("v2").alias("advertiserid"), "corr_ctr")
    out = st.lookup(data.select("uid", "aid", "carrier", "advertiserid"), x, ["carrier", "advertiserid"])
    return out.select("uid", "aid", r6(F.col("corr_ctr")).alias("corr_ctr"))


@register("lookup_three_way", with_base(
    f"dc AS (SELECT *, {_cnt_sql('kw1')} AS kw1cnt FROM data)",
    "x AS (SELECT carrier, kw1cnt, aid, sum(label) / count(label) AS corr_ctr FROM dc WHERE label IS NOT NULL "
    "GROUP BY carrier, kw1cnt, aid)",
    select="SELECT d.uid, d.aid, d.kw1cnt, round(x.corr_ctr, 6) AS corr_ctr FROM dc d LEFT JOIN x "
           "ON d.carrier = x.carrier AND d.kw1cnt = x.kw1cnt AND d.aid = x.aid"))
def lookup_three_way(spark, d):
    data = st.with_token_counts(S.data_all(spark, d), ["kw1"])
    x = st.cross_ctr(data, [("carrier", "kw1cnt", "aid")]).select(
        F.col("v1").alias("carrier"), F.col("v2").cast("bigint").alias("kw1cnt"), F.col("v3").cast("bigint").alias("aid"),
        "corr_ctr")
    out = st.lookup(data.select("uid", "aid", "carrier", "kw1cnt"), x, ["carrier", "kw1cnt", "aid"])
    return out.select("uid", "aid", "kw1cnt", r6(F.col("corr_ctr")).alias("corr_ctr"))


@register("lookup_uid_aid", with_base(
    "x AS (SELECT lbs, aid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY lbs, aid)",
    "s AS (SELECT l.uid, l.aid, x.corr_ctr AS lbs_aid_ctr FROM lab l JOIN x ON l.lbs = x.lbs AND l.aid = x.aid)",
    select="SELECT d.uid, d.aid, round(s.lbs_aid_ctr, 6) AS lbs_aid_ctr FROM data d "
           "LEFT JOIN s ON d.uid = s.uid AND d.aid = s.aid"))
def lookup_uid_aid(spark, d):
    """A statistic delivered keyed by (uid, aid) is attached to every instance."""
    data = S.data_all(spark, d)
    lab = data.where(F.col("label").isNotNull())
    per_pair = lab.select("uid", "aid", "lbs").join(_raw_ctr(data, "lbs"), ["lbs", "aid"]).select(
        "uid", "aid", F.col("corr_ctr").alias("lbs_aid_ctr"))
    out = st.lookup(data.select("uid", "aid"), per_pair, ["uid", "aid"])
    return out.withColumn("lbs_aid_ctr", r6(F.col("lbs_aid_ctr")))


@register("lookup_uid_aid_many", _pair_sql())
def lookup_uid_aid_many(spark, d):
    """42 statistics delivered as tables keyed by (uid, aid), one table per user feature, attached to every
    instance: all tables are bucketed by the key, so none is shuffled."""
    rows, tables = st.pair_tables(S.data_all(spark, d), PAIR_AD, PAIR_USER)
    out = st.attach_bucketed(rows, tables)
    return out.select("uid", "aid", *[F.col(c) if c.endswith("_cnt") else r6(F.col(c)).alias(c)
                                      for c in out.columns if c not in ("uid", "aid")])


@register("column_concat", with_base(
    "v AS (SELECT aid, count(*) AS delivery FROM data GROUP BY aid)",
    f"dc AS (SELECT uid, aid, {_cnt_sql('kw1')} AS kw1cnt, {_cnt_sql('interest1')} AS interest1cnt FROM data)",
    select="SELECT d.uid, d.aid, v.delivery, dc.kw1cnt, dc.interest1cnt FROM data d JOIN v ON d.aid = v.aid "
           "JOIN dc ON d.uid = dc.uid AND d.aid = dc.aid"))
def column_concat(spark, d):
    """Columns of two lookups of the same instances next to each other."""
    data = S.data_all(spark, d)
    left = st.lookup(data.select("uid", "aid"), st.delivery_volume(data), ["aid"]).select("uid", "aid", "delivery")
    right = st.with_token_counts(data, ["kw1", "interest1"]).select("uid", "aid", "kw1cnt", "interest1cnt")
    return instances.column_concat(left, right, ["uid", "aid"])


@register("lookup_count_aid", with_base(
    f"dc AS (SELECT *, {_cnt_sql('interest1')} AS interest1cnt FROM data)",
    "x AS (SELECT interest1cnt, aid, sum(label) / count(label) AS corr_ctr FROM dc WHERE label IS NOT NULL "
    "GROUP BY interest1cnt, aid)",
    select="SELECT d.uid, d.aid, d.interest1cnt, round(x.corr_ctr, 6) AS corr_ctr FROM dc d LEFT JOIN x "
           "ON d.interest1cnt = x.interest1cnt AND d.aid = x.aid"))
def lookup_count_aid(spark, d):
    data = st.with_token_counts(S.data_all(spark, d), ["interest1"])
    x = st.count_ctr_aid(data, "interest1").select("interest1cnt", "aid", "corr_ctr")
    out = st.lookup(data.select("uid", "aid", "interest1cnt"), x, ["interest1cnt", "aid"])
    return out.withColumn("corr_ctr", r6(F.col("corr_ctr")))


@register("lookup_batch", with_base(
    DATA_LONG, LAB_LONG, CELLS,
    select="SELECT l.uid, l.aid, " + ", ".join(
        f"round(max(CASE WHEN l.factor_name = '{f}' THEN c.clicks / c.impressions END), 6) AS {f}_ctr"
        for f in S.CROSS_FACTORS) +
    " FROM data_long l LEFT JOIN cells c ON l.factor_name = c.factor_name AND l.value = c.value AND l.aid = c.aid "
    "GROUP BY l.uid, l.aid"))
def lookup_batch(spark, d):
    data = S.data_all(spark, d)
    stats = st.ctr_by_value_aid(data, S.CROSS_FACTORS)
    out = st.attach_long(data, ["uid", "aid"], S.CROSS_FACTORS, stats, "ctr", ["aid"], suffix="_ctr")
    return out.select("uid", "aid", *[r6(F.col(f"{f}_ctr")).alias(f"{f}_ctr") for f in S.CROSS_FACTORS])


@register("lookup_fill_zero", with_base(
    "x AS (SELECT lbs, aid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY lbs, aid)",
    select="SELECT d.uid, d.aid, round(coalesce(x.corr_ctr, 0.0), 6) AS corr_ctr FROM data d "
           "LEFT JOIN x ON d.lbs = x.lbs AND d.aid = x.aid"))
def lookup_fill_zero(spark, d):
    data = S.data_all(spark, d)
    out = st.lookup(data.select("uid", "aid", "lbs"), _raw_ctr(data, "lbs"), ["lbs", "aid"], fill={"corr_ctr": 0.0})
    return out.select("uid", "aid", r6(F.col("corr_ctr")).alias("corr_ctr"))


@register("join_cardinality", with_base(
    "v AS (SELECT aid, count(*) AS n FROM data GROUP BY aid)",
    "x AS (SELECT lbs, aid, count(*) AS n FROM lab GROUP BY lbs, aid)",
    "y AS (SELECT carrier, advertiserid, count(*) AS n FROM lab GROUP BY carrier, advertiserid)",
    select="SELECT 'lookup_aid' AS lookup_name, (SELECT count(*) FROM data) AS rows_before, "
           "(SELECT count(*) FROM data d LEFT JOIN v ON d.aid = v.aid) AS rows_after "
           "UNION ALL SELECT 'lookup_feature_aid', (SELECT count(*) FROM data), "
           "(SELECT count(*) FROM data d LEFT JOIN x ON d.lbs = x.lbs AND d.aid = x.aid) "
           "UNION ALL SELECT 'lookup_feature_adfeature', (SELECT count(*) FROM data), "
           "(SELECT count(*) FROM data d LEFT JOIN y ON d.carrier = y.carrier AND d.advertiserid = y.advertiserid)"))
def join_cardinality(spark, d):
    """Row counts before and after each lookup (a lookup must not fan out)."""
    data = S.data_all(spark, d)
    lookups = {
        "lookup_aid": st.lookup(data.select("aid"), st.delivery_volume(data), ["aid"]),
        "lookup_feature_aid": st.lookup(data.select("lbs", "aid"), _raw_ctr(data, "lbs"), ["lbs", "aid"]),
        "lookup_feature_adfeature": st.lookup(
            data.select("carrier", "advertiserid"),
            st.cross_ctr(data, [("carrier", "advertiserid")]).select(
                F.col("v1").alias("carrier"), F.col("v2").alias("advertiserid"), "corr_ctr"),
            ["carrier", "advertiserid"]),
    }
    before = data.count()
    out = None
    for name, j in lookups.items():
        row = j.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("lookup_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("lookup_name", F.lit(before).alias("rows_before"), "rows_after")


# ----------------------------------------------------------------------------- B1-B7, F11
@register("beta_fit_step", with_base(LAB_LONG, CELLS, *fit_steps_ctes("cells", 1)[0], select=(
    "SELECT p1.factor_name, round(p1.alpha, 6) AS alpha, round(p1.beta, 6) AS beta, round(s.sum_a, 6) AS sum_a, "
    "round(s.sum_b, 6) AS sum_b, round(s.sum_m, 6) AS sum_m FROM p1 JOIN ("
    f"SELECT factor_name, sum(n_cells * {digamma_diff_sql('clicks', '1.0')}) AS sum_a, "
    f"sum(n_cells * {digamma_diff_sql('impressions - clicks', '1.0')}) AS sum_b, "
    f"sum(n_cells * {digamma_diff_sql('impressions', '2.0')}) AS sum_m FROM phist GROUP BY factor_name) s "
    "ON p1.factor_name = s.factor_name")))
def beta_fit_step(spark, d):
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS)
    hist = cell_histogram(cells, ["factor_name"])
    p0 = hist.select("factor_name").distinct().select("factor_name", F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"))
    out = beta_step(hist, p0, ["factor_name"])
    return out.select("factor_name", *[r6(F.col(c)).alias(c) for c in ["alpha", "beta", "sum_a", "sum_b", "sum_m"]])


@register("beta_fit", with_base(LAB_LONG, CELLS, *fit_steps_ctes("cells", FIT_STEPS)[0], select=(
    f"SELECT factor_name, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM p{FIT_STEPS}")))
def beta_fit(spark, d):
    """Fixed number of updates, every step a Spark aggregate over the count histogram."""
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS)
    p = fit_beta_steps(cells, ["factor_name"], FIT_STEPS)
    return p.select("factor_name", r6(F.col("alpha")).alias("alpha"), r6(F.col("beta")).alias("beta"))


@register("beta_fit_converged", with_base(
    LAB_LONG, CELLS, "hist AS (SELECT factor_name, clicks, impressions, count(*) AS n_cells FROM cells "
                     "GROUP BY factor_name, clicks, impressions)",
    *fit_converged_ctes("hist")[0], recursive=True,
    select="SELECT factor_name, round(alpha, 6) AS alpha, round(beta, 6) AS beta, n_iter, converged FROM fitted"))
def beta_fit_converged(spark, d):
    """Reference fit: start (1, 1), up to 1000 updates, stop below 1e-8."""
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS)
    out = fit_beta(cells, ["factor_name"])
    return out.select("factor_name", r6(F.col("alpha")).alias("alpha"), r6(F.col("beta")).alias("beta"),
                      "n_iter", "converged")


def _smoothed_sql(cells: str, params: str, keys: str, complement: bool = False) -> str:
    ratio = "(c.clicks + p.alpha) / (c.impressions + p.alpha + p.beta)"
    val = f"1.0 - {ratio}" if complement else ratio
    return (f"SELECT {keys}, round(c.clicks + p.alpha, 6) AS clicks, round(c.impressions + p.alpha + p.beta, 6) "
            f"AS impressions, round({val}, 6) AS ctr FROM {cells} c JOIN {params} p ON c.factor_name = p.factor_name")


def _round_counts(df):
    return df.select(*[r6(F.col(c)).alias(c) if c in ("clicks", "impressions", "ctr") else F.col(c)
                       for c in df.columns])


@register("smoothed_complement", with_base(LAB_TOK, TOK_CELLS, *converged_fit_ctes("tok_cells"), select=(
    _smoothed_sql("tok_cells", "fitted", "c.factor_name, c.single_value", complement=True))))
def smoothed_complement(spark, d):
    counts = st.ctr_by_value(S.labelled(spark, d), S.TOKEN_FACTORS).drop("ctr")
    return _round_counts(fit_and_smooth(counts, ["factor_name"], complement=True))


@register("smoothed_ctr", with_base(
    LAB_LONG, "cells AS (SELECT factor_name, value, aid, CAST(sum(label) AS BIGINT) AS clicks, count(*) AS impressions "
              "FROM lab_long WHERE factor_name = 'lbs' GROUP BY factor_name, value, aid)",
    *converged_fit_ctes("cells"),
    select=_smoothed_sql("cells", "fitted", "c.value AS lbs, c.aid")))
def smoothed_ctr(spark, d):
    cells = st.ctr_by_value_aid(S.labelled(spark, d), ["lbs"]).drop("ctr")
    out = fit_and_smooth(cells, ["factor_name"])
    return _round_counts(out.select(F.col("value").alias("lbs"), "aid", "clicks", "impressions", "ctr"))


@register("smoothed_ctr_all", with_base(LAB_LONG, CELLS, *converged_fit_ctes("cells"), select=(
    _smoothed_sql("cells", "fitted", "c.factor_name, c.value, c.aid"))))
def smoothed_ctr_all(spark, d):
    """Every factor in one aggregation and one grouped fit (no process pool)."""
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS).drop("ctr")
    return _round_counts(fit_and_smooth(cells, ["factor_name"]))


@register("attach_smoothed_ctr", with_base(
    LAB_LONG, CELLS, *converged_fit_ctes("cells"), DATA_LONG,
    f"sm AS (SELECT c.factor_name, c.value, c.aid, (c.clicks + p.alpha) / (c.impressions + p.alpha + p.beta) AS ctr "
    f"FROM cells c JOIN fitted p ON c.factor_name = p.factor_name)",
    select="SELECT l.uid, l.aid, " + ", ".join(
        f"round(max(CASE WHEN l.factor_name = '{f}' THEN s.ctr END), 6) AS {f}_ctr_smooth" for f in S.CROSS_FACTORS) +
    " FROM data_long l LEFT JOIN sm s ON l.factor_name = s.factor_name AND l.value = s.value AND l.aid = s.aid "
    "GROUP BY l.uid, l.aid"))
def attach_smoothed_ctr(spark, d):
    """Smoothed (value, aid) CTR of every factor attached to train and test rows by
    the raw value, with one join for all factors."""
    data = S.data_all(spark, d)
    cells = st.ctr_by_value_aid(data, S.CROSS_FACTORS).drop("ctr")
    sm = fit_and_smooth(cells, ["factor_name"])
    out = st.attach_long(data, ["uid", "aid"], S.CROSS_FACTORS, sm, "ctr", ["aid"], suffix="_ctr_smooth")
    return out.select("uid", "aid", *[r6(F.col(c)).alias(c) for c in out.columns if c.endswith("_ctr_smooth")])


@register("zero_filled_ctr", with_base(
    LAB_LONG, CELLS, DATA_LONG,
    "grid AS (SELECT DISTINCT factor_name, value, aid FROM data_long)",
    "filled AS (SELECT g.factor_name, g.value, g.aid, coalesce(c.clicks, 0) AS clicks, "
    "coalesce(c.impressions, 0) AS impressions FROM grid g LEFT JOIN cells c "
    "ON g.factor_name = c.factor_name AND g.value = c.value AND g.aid = c.aid)",
    *converged_fit_ctes("filled"),
    select=f"SELECT c.factor_name, c.value, c.aid, c.clicks AS raw_clicks, c.impressions AS raw_impressions, "
           f"round((c.clicks + p.alpha) / (c.impressions + p.alpha + p.beta), 6) AS ctr "
           f"FROM filled c JOIN fitted p ON c.factor_name = p.factor_name"))
def zero_filled_ctr(spark, d):
    """Every (value, aid) cell seen in train or test, zero counts where train has
    none, smoothed so that empty cells get alpha / (alpha + beta)."""
    data = S.data_all(spark, d)
    grid = st.long_form(data, S.CROSS_FACTORS, ["aid"]).distinct()
    cells = st.ctr_by_value_aid(data, S.CROSS_FACTORS).drop("ctr")
    filled = st.lookup(grid, cells, ["factor_name", "value", "aid"], fill={"clicks": 0, "impressions": 0})
    out = fit_and_smooth(filled, ["factor_name"], adjust_counts=False)
    return out.select("factor_name", "value", "aid", F.col("clicks").alias("raw_clicks"),
                      F.col("impressions").alias("raw_impressions"), r6(F.col("ctr")).alias("ctr"))


USERS_FILLED = ("uf AS (SELECT uid, coalesce(kw1, '-1') AS kw1, coalesce(interest1, '-1') AS interest1 FROM users "
                "WHERE uid IN (SELECT uid FROM data))")
NOISY_CTES = [LAB_TOK, TOK_CELLS, *converged_fit_ctes("tok_cells"),
              f"comp AS (SELECT c.factor_name, c.single_value, 1.0 - (c.clicks + p.alpha) / "
              f"(c.impressions + p.alpha + p.beta) AS q FROM tok_cells c JOIN fitted p "
              f"ON c.factor_name = p.factor_name)",
              USERS_FILLED,
              f"ut AS ({_tok_sql('uf', ['uid'], S.TOKEN_FACTORS)})",
              "nor AS (SELECT t.uid, t.factor_name, product(c.q) AS noisy_or FROM ut t LEFT JOIN comp c "
              "ON t.factor_name = c.factor_name AND t.single_value = c.single_value GROUP BY t.uid, t.factor_name)",
              "fl AS (SELECT uid, 'kw1' AS factor_name, kw1 AS raw FROM uf UNION ALL "
              "SELECT uid, 'interest1', interest1 FROM uf)"]


def _noisy_or_per_user(spark, d, lab=None):
    """Product of per-token smoothed no-click probabilities, learned from ``lab`` (all labelled rows
    by default). Token fields belong to the user, so the product is computed once per user
    (not per instance) and joined."""
    lab = S.labelled(spark, d) if lab is None else lab
    counts = st.ctr_by_value(lab, S.TOKEN_FACTORS).drop("ctr")
    comp = fit_and_smooth(counts, ["factor_name"], complement=True, out="q", adjust_counts=False)
    data = S.data_all(spark, d)
    users = clean.null_to_sentinel(S.users(spark, d), S.TOKEN_FACTORS).join(
        data.select("uid").distinct(), "uid", "left_semi")
    per_user = st.noisy_or(st.long_tokens(users, S.TOKEN_FACTORS, ["uid"]), comp, ["uid"], "q")
    return data, users, per_user


@register("token_noisy_or", with_base(*NOISY_CTES, select=(
    "SELECT d.uid, d.aid, n.factor_name, round(n.noisy_or, 6) AS noisy_or FROM data d JOIN nor n ON d.uid = n.uid")))
def token_noisy_or(spark, d):
    data, _, per_user = _noisy_or_per_user(spark, d)
    out = data.select("uid", "aid").join(per_user, "uid")
    return out.select("uid", "aid", "factor_name", r6(F.col("noisy_or")).alias("noisy_or"))


@register("token_noisy_or_filled", with_base(*NOISY_CTES, select=(
    "SELECT d.uid, d.aid, f.factor_name, round(CASE WHEN f.raw = '-1' THEN -1.0 ELSE coalesce(n.noisy_or, 0.0) END, 6) "
    "AS noisy_or FROM data d JOIN fl f ON d.uid = f.uid "
    "LEFT JOIN nor n ON f.uid = n.uid AND f.factor_name = n.factor_name")))
def token_noisy_or_filled(spark, d, lab=None):
    """Misses -> 0, users whose field is the missing marker -> -1."""
    data, users, per_user = _noisy_or_per_user(spark, d, lab)
    raw = st.long_form(users, S.TOKEN_FACTORS, ["uid"], value_col="raw")
    filled = raw.join(per_user, ["uid", "factor_name"], "left").fillna({"noisy_or": 0.0})
    filled = clean.sentinel_override(filled, "raw", "noisy_or")
    out = data.select("uid", "aid").join(filled, "uid")
    return out.select("uid", "aid", "factor_name", r6(F.col("noisy_or")).alias("noisy_or"))


@register("digamma_difference", with_base(LAB_LONG, CELLS, select=(
    f"SELECT factor_name, value, aid, round({digamma_diff_sql('clicks', '0.5')}, 6) AS d_alpha, "
    f"round({digamma_diff_sql('impressions', '1.5')}, 6) AS d_total FROM cells")))
def digamma_difference_q(spark, d):
    cells = st.ctr_by_value_aid(S.labelled(spark, d), S.CROSS_FACTORS)
    return cells.select("factor_name", "value", "aid",
                        r6(digamma_difference(F.col("clicks"), F.lit(0.5))).alias("d_alpha"),
                        r6(digamma_difference(F.col("impressions"), F.lit(1.5))).alias("d_total"))
