"""Flagship query, cleaning, instance joins, unions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctrkit.operators import clean, instances
from ctrkit.operators.evaluate import auc_from_counts
from ctrkit.operators.smoothing import fit_beta, smooth
from ctrkit.session import shared_root
from ctrkit.operators.stats import cross_ctr, ctr_by_value_aid, long_form
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import auc_ctes, converged_fit_ctes, unpivot_sql, with_base



def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------------
# Flagship: how well does the smoothed CTR of (user attribute, ad) rank responses?
# ---------------------------------------------------------------------------------
_CROSS_LIST = ", ".join(f"'{f}'" for f in S.CROSS_FACTORS)
FLAGSHIP_SQL = with_base(
    f"lab_long AS ({unpivot_sql('lab', ['uid', 'aid', 'label'], S.CROSS_FACTORS)})",
    "cells AS (SELECT factor_name, value, aid, CAST(sum(label) AS BIGINT) AS clicks, count(*) AS impressions "
    "FROM lab_long GROUP BY factor_name, value, aid)",
    *converged_fit_ctes("cells"),
    f"sm AS (SELECT c.factor_name, c.value, c.aid, (c.clicks + p.alpha) / (c.impressions + p.alpha + p.beta) AS ctr "
    f"FROM cells c JOIN fitted p ON c.factor_name = p.factor_name)",
    "scored AS (SELECT l.factor_name, s.ctr AS score, l.label FROM lab_long l LEFT JOIN sm s "
    "ON l.factor_name = s.factor_name AND l.value = s.value AND l.aid = s.aid)",
    *auc_ctes("scored")[0],
    select=f"SELECT a.factor_name, round(p.alpha, 6) AS alpha, round(p.beta, 6) AS beta, round(a.auc, 6) AS auc, "
           f"a.n_pos, a.n_neg FROM auc a JOIN fitted p ON a.factor_name = p.factor_name")


@register("smoothed_ctr_auc", FLAGSHIP_SQL)
def smoothed_ctr_auc(spark, d):
    """Every labelled row belongs to exactly one (factor, value, aid) cell and is scored
    with that cell's smoothed CTR, so the AUC histogram comes from the cells themselves
    (clicks = positives, impressions - clicks = negatives): one pass over the rows."""
    lab = S.labelled(spark, d)
    shared_root(spark)
    cells = ctr_by_value_aid(lab, S.CROSS_FACTORS).checkpoint(eager=True)
    params = fit_beta(cells, ["factor_name"], materialize=True)
    scored = smooth(cells, params, ["factor_name"], out="score", adjust_counts=False).withColumn(
        "neg", F.col("impressions") - F.col("clicks"))
    auc = auc_from_counts(scored, "score", "clicks", "neg", ["factor_name"])
    return auc.join(params, "factor_name").select(
        "factor_name", r6(F.col("alpha")).alias("alpha"), r6(F.col("beta")).alias("beta"),
        r6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


# ---------------------------------------------------------------------------------
# Sources of the instance table, joins, unions
# ---------------------------------------------------------------------------------
_JOIN_COLS = "aid, uid, label, lbs, house, carrier, consumptionability, kw1, interest1, os, " \
             "advertiserid, producttype, creativesize"


@register("instance_join", with_base(select=f"SELECT {_JOIN_COLS} FROM joined_train"))
def instance_join(spark, d):
    return S.joined_train(spark, d).select(*_JOIN_COLS.split(", "))


@register("recode_label", with_base(
    select="SELECT aid, uid, CAST(CASE WHEN label = -1 THEN 0 ELSE label END AS BIGINT) AS label FROM train"))
def recode_label(spark, d):
    return clean.recode_label(S.train_instances(spark, d))


@register("union_train_test", with_base(
    select="SELECT aid, uid, label FROM train UNION ALL SELECT aid, uid, CAST(-2 AS BIGINT) AS label FROM test"))
def union_train_test(spark, d):
    return instances.union_marked(S.train_instances(spark, d), S.test_instances(spark, d))


@register("tag_source", with_base(
    select="SELECT aid, uid, label, CAST(1 AS INTEGER) AS qubie FROM train "
           "UNION ALL SELECT aid, uid, CAST(NULL AS BIGINT) AS label, CAST(2 AS INTEGER) AS qubie FROM test"))
def tag_source(spark, d):
    return instances.union_sources({1: S.train_instances(spark, d), 2: S.test_instances(spark, d)}, "qubie")


@register("empty_to_null", with_base(select="SELECT * FROM users"))
def empty_to_null(spark, d):
    return clean.empty_to_null(S.user_profiles(spark, d), S.USER_COLS)


@register("null_to_sentinel", with_base(select="SELECT * FROM data"))
def null_to_sentinel(spark, d):
    """Built from the raw tables (train and test joined, NULL -> '-1' on user columns)."""
    return S.build_data_all(spark, d)


@register("project_columns", with_base(select="SELECT aid, uid, lbs, carrier, advertiserid FROM data"))
def project_columns(spark, d):
    return S.data_all(spark, d).select("aid", "uid", "lbs", "carrier", "advertiserid")


@register("split_labelled", with_base(
    select="SELECT aid, uid, label, lbs FROM data WHERE label IS NOT NULL"))
def split_labelled(spark, d):
    lab, _ = clean.split_labelled(S.data_all(spark, d))
    return lab.select("aid", "uid", "label", "lbs")


@register("drop_columns", with_base(
    select="SELECT aid, uid, label, lbs, house, carrier, consumptionability, advertiserid, producttype, "
           "creativesize FROM data"))
def drop_columns(spark, d):
    return clean.drop_columns(S.data_all(spark, d), ["kw1", "interest1", "os"])


_MISSING_COLS = S.USER_COLS + S.AD_COLS
_MISSING_SQL = with_base(
    "both_sides AS (SELECT lbs, house, carrier, consumptionability, kw1, interest1, os, advertiserid, producttype, "
    "creativesize FROM joined_train UNION ALL SELECT lbs, house, carrier, consumptionability, kw1, interest1, os, "
    "advertiserid, producttype, creativesize FROM joined_test)",
    select="\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL OR {c} = '-1' THEN 1.0 ELSE 0.0 END), 6) "
        f"AS missing_rate FROM both_sides" for c in _MISSING_COLS))


@register("missing_rate", _MISSING_SQL)
def missing_rate(spark, d):
    both = S.joined_train(spark, d).drop("label").unionByName(S.joined_test(spark, d))
    out = clean.missing_rate(both, _MISSING_COLS)
    return out.select("column_name", r6(F.col("missing_rate")).alias("missing_rate"))


MISSING_LIMIT = 0.1


@register("drop_high_missing", with_base(
    "rates AS (SELECT avg(CASE WHEN carrier = '-1' THEN 1.0 ELSE 0.0 END) AS carrier FROM data)",
    select="SELECT " + ", ".join(["aid", "uid", *[c for c in _MISSING_COLS if c != "carrier"]]) +
           f" FROM data WHERE (SELECT carrier FROM rates) > {MISSING_LIMIT}"))
def drop_high_missing(spark, d):
    """Columns that are missing in more than a tenth of the rows are dropped (here: carrier)."""
    data = S.data_all(spark, d).select("aid", "uid", *_MISSING_COLS)
    return clean.drop_high_missing(data, _MISSING_COLS, MISSING_LIMIT)


@register("scale_ctr", with_base(
    "x AS (SELECT lbs, aid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY lbs, aid)",
    select="SELECT lbs, aid, round(corr_ctr * 100, 6) AS corr_ctr FROM x"))
def scale_ctr(spark, d):
    """The statistic as a percentage."""
    x = cross_ctr(S.labelled(spark, d), [("lbs",)], ["aid"]).select(F.col("v1").alias("lbs"), "aid", "corr_ctr")
    return clean.scale_columns(x, ["corr_ctr"]).withColumn("corr_ctr", r6(F.col("corr_ctr")))


@register("cast_keys", with_base(
    select="SELECT uid, TRY_CAST(consumptionability AS BIGINT) AS consumptionability, "
           "TRY_CAST(carrier AS BIGINT) AS carrier, TRY_CAST(lbs AS BIGINT) AS lbs FROM users_raw"))
def cast_keys(spark, d):
    u = S.user_profiles(spark, d).select("uid", "consumptionability", "carrier", "lbs")
    return clean.cast_keys(u, ["consumptionability", "carrier", "lbs"])


# Column names as the raw profile header spells them.
RAW_HEADER_NAMES = {"lbs": "LBS", "consumptionability": "consumptionAbility"}


@register("normalise_names", with_base(select="SELECT * FROM users_raw"))
def normalise_names(spark, d):
    raw = S.user_profiles(spark, d)
    camel = raw.toDF(*[RAW_HEADER_NAMES.get(c, c) for c in raw.columns])
    return clean.normalise_names(camel)


@register("sentinel_override", with_base(
    "x AS (SELECT carrier, aid, sum(label) / count(*) AS corr_ctr FROM lab GROUP BY carrier, aid)",
    select="SELECT l.uid, l.aid, l.carrier, round(CASE WHEN l.carrier = '-1' THEN -1.0 ELSE x.corr_ctr END, 6) "
           "AS carrier_aid_ctr FROM lab l LEFT JOIN x ON l.carrier = x.carrier AND l.aid = x.aid"))
def sentinel_override(spark, d):
    lab = S.labelled(spark, d)
    x = cross_ctr(lab, [("carrier",)], ["aid"]).select(
        F.col("v1").alias("carrier"), "aid", F.col("corr_ctr").alias("carrier_aid_ctr"))
    out = clean.sentinel_override(lab.select("uid", "aid", "carrier").join(x, ["carrier", "aid"], "left"),
                                  "carrier", "carrier_aid_ctr")
    return out.select("uid", "aid", "carrier", r6(F.col("carrier_aid_ctr")).alias("carrier_aid_ctr"))


# ---------------------------------------------------------------------------------
# Splits and weights
# ---------------------------------------------------------------------------------
def _bucket_sql(key: str, salt: str | None = None) -> str:
    k = f"'{salt}' || '_' || {key}" if salt else key
    return f"(CAST(('0x' || substr(md5({k}), 1, 7)) AS BIGINT) % 100)"


_KEY = "CAST(uid AS VARCHAR) || '_' || CAST(aid AS VARCHAR)"


@register("hash_split", with_base(
    select=f"SELECT aid, uid, CASE WHEN {_bucket_sql(_KEY)} < 70 THEN 'train' ELSE 'valid' END AS split FROM data"))
def hash_split(spark, d):
    return instances.hash_split(S.data_all(spark, d).select("aid", "uid"), ["uid", "aid"], 70)


@register("cascaded_split", with_base(
    select=f"SELECT aid, uid, CASE WHEN {_bucket_sql(_KEY, 'split')} < 70 THEN 'train' ELSE 'valid' END AS split "
           f"FROM lab WHERE {_bucket_sql(_KEY, 'sample')} < 20"))
def cascaded_split(spark, d):
    return instances.cascaded_split(S.labelled(spark, d).select("aid", "uid"), ["uid", "aid"], 20, 70)


@register("balanced_weights", with_base(
    "w AS (SELECT label, count(*) AS n FROM lab GROUP BY label)",
    select="SELECT l.aid, l.uid, l.label, round((SELECT sum(n) FROM w) / ((SELECT count(*) FROM w) * w.n), 6) "
           "AS weight FROM lab l JOIN w ON l.label = w.label"))
def balanced_weights(spark, d):
    out = instances.balanced_weights(S.labelled(spark, d).select("aid", "uid", "label"))
    return out.select("aid", "uid", "label", r6(F.col("weight")).alias("weight"))
