"""Token fields: explode, vocabulary, counts, importance ranking, top-N cut, crosses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctrkit.functions import crosses as X
from ctrkit.functions.tokens import replace_token, token_count
from ctrkit.operators import clean
from ctrkit.operators import tokens as T
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import with_base
from ctrkit.plans.q_stats import LAB_TOK, USERS_FILLED, _cnt_sql, _tok_sql

# Fixed parameters of the stand-in: number of tokens kept per field.
TOP_N = {"kw1": 20, "interest1": 10}
_TOPN_SQL = "CASE factor_name WHEN 'kw1' THEN 20 ELSE 10 END"

IMP = ("imp AS (SELECT factor_name, single_value, count(*) AS import_value FROM lab_tok "
       "GROUP BY factor_name, single_value)")
RANKED = ("ranked AS (SELECT factor_name, single_value, import_value, CAST(row_number() OVER (PARTITION BY factor_name "
          "ORDER BY import_value DESC, single_value) AS BIGINT) AS rank FROM imp WHERE single_value <> '-1')")


def _users_filled(spark, d):
    data = S.data_all(spark, d)
    return clean.null_to_sentinel(S.users(spark, d), S.USER_COLS).join(data.select("uid").distinct(), "uid",
                                                                       "left_semi")


@register("explode_tokens", with_base(select=_tok_sql("data", ["uid", "aid"], S.TOKEN_FACTORS)))
def explode_tokens(spark, d):
    return T.explode_tokens(S.data_all(spark, d), S.TOKEN_FACTORS)


VOCAB_FIELDS = ["kw1", "interest1", "os"]


@register("vocabulary", with_base(select=" UNION ".join(
    f"SELECT DISTINCT '{f}' AS factor_name, unnest(string_split({f}, ' ')) AS token FROM users WHERE {f} IS NOT NULL"
    for f in VOCAB_FIELDS)))
def vocabulary(spark, d):
    return T.vocabulary(S.users(spark, d), VOCAB_FIELDS)


@register("token_count", with_base(USERS_FILLED.replace(
    "coalesce(interest1, '-1') AS interest1", "coalesce(interest1, '-1') AS interest1, coalesce(os, '-1') AS os, "
    "coalesce(carrier, '-1') AS carrier"), select=(
    f"SELECT uid, {_cnt_sql('kw1')} AS kw1cnt, {_cnt_sql('interest1')} AS interest1cnt, {_cnt_sql('os')} AS oscnt, "
    f"{_cnt_sql('carrier')} AS carriercnt FROM uf")))
def token_count_q(spark, d):
    u = _users_filled(spark, d)
    return u.select("uid", *[token_count(f).alias(f"{f}cnt") for f in ["kw1", "interest1", "os", "carrier"]])


@register("topn_cut_set", with_base(LAB_TOK, IMP, RANKED, select=(
    f"SELECT factor_name, single_value, import_value, rank FROM ranked WHERE rank > {_TOPN_SQL}")))
def topn_cut_set(spark, d):
    imp = T.token_importance(S.data_all(spark, d), S.TOKEN_FACTORS)
    return T.topn_cut_set(imp, TOP_N).select("factor_name", "single_value", "import_value", "rank")


@register("nth_value", with_base(LAB_TOK, IMP, RANKED, select=(
    f"SELECT factor_name, single_value, import_value, rank FROM ranked WHERE rank = {_TOPN_SQL} + 1")))
def nth_value(spark, d):
    imp = T.token_importance(S.data_all(spark, d), S.TOKEN_FACTORS)
    return T.nth_value(imp, TOP_N).select("factor_name", "single_value", "import_value", "rank")


CUT_SQL = with_base(
    LAB_TOK, IMP, RANKED, USERS_FILLED,
    f"cut AS (SELECT factor_name, single_value FROM ranked WHERE rank > {_TOPN_SQL})",
    "ut AS (SELECT uid, 'kw1' AS factor_name, kw1 AS v FROM uf UNION ALL SELECT uid, 'interest1', interest1 FROM uf)",
    "ex AS (SELECT uid, factor_name, unnest(string_split(v, ' ')) AS tok, "
    "generate_subscripts(string_split(v, ' '), 1) AS pos FROM ut)",
    "rb AS (SELECT e.uid, e.factor_name, string_agg(CASE WHEN c.single_value IS NOT NULL THEN 'other' ELSE e.tok END, "
    "' ' ORDER BY e.pos) AS v FROM ex e LEFT JOIN cut c ON e.factor_name = c.factor_name AND e.tok = c.single_value "
    "GROUP BY e.uid, e.factor_name)",
    select="SELECT uid, max(CASE WHEN factor_name = 'kw1' THEN v END) AS kw1, "
           "max(CASE WHEN factor_name = 'interest1' THEN v END) AS interest1 FROM rb GROUP BY uid")


@register("cut_tokens", CUT_SQL)
def cut_tokens(spark, d):
    """Tail cut: tokens ranked below the top N of their field -> 'other', applied to
    the user dimension (token fields are user attributes)."""
    imp = T.token_importance(S.data_all(spark, d), S.TOKEN_FACTORS)
    cut = T.topn_cut_set(imp, TOP_N)
    users = _users_filled(spark, d).select("uid", *S.TOKEN_FACTORS)
    return T.cut_tokens(users, ["uid"], S.TOKEN_FACTORS, cut)


@register("cut_one_token", with_base(USERS_FILLED, select=(
    "SELECT uid, array_to_string(list_transform(string_split(kw1, ' '), lambda t: CASE WHEN t = '1' THEN 'other' "
    "ELSE t END), ' ') AS kw1 FROM uf")))
def cut_one_token(spark, d):
    """one id replaced as a whole token; the sentinel ``-1`` is left alone."""
    return _users_filled(spark, d).select("uid", replace_token("kw1", "1").alias("kw1"))


@register("pair_cross", with_base(select="SELECT uid, aid, concat_ws(' ', carrier, lbs) AS carrier_lbs FROM data"))
def pair_cross(spark, d):
    return S.data_all(spark, d).select("uid", "aid", X.pair_cross("carrier", "lbs").alias("carrier_lbs"))


PAIR_FEATURES = ["lbs", "house", "carrier", "consumptionability"]


@register("all_pair_crosses", with_base(select="SELECT uid, aid, " + ", ".join(
    f"concat_ws(' ', {a}, {b}) AS {a}_{b}" for a, b in X.all_pairs(PAIR_FEATURES)) + " FROM data"))
def all_pair_crosses(spark, d):
    return S.data_all(spark, d).select("uid", "aid", *[c.alias(n) for n, c in X.all_pair_crosses(PAIR_FEATURES).items()])


COMBO2 = [("lbs", "aid"), ("carrier", "advertiserid"), ("os", "producttype")]
COMBO3 = [("lbs", "carrier", "aid"), ("consumptionability", "house", "creativesize")]


def _combo_sql(combos):
    return with_base(select="SELECT uid, aid, " + ", ".join(
        f"concat_ws('_', {', '.join(f'CAST({c} AS VARCHAR)' for c in combo)}) AS {'_'.join(combo)}"
        for combo in combos) + " FROM data")


@register("combination_2", _combo_sql(COMBO2))
def combination_2(spark, d):
    return S.data_all(spark, d).select("uid", "aid", *[X.combination(list(c)).alias("_".join(c)) for c in COMBO2])


@register("combination_3", _combo_sql(COMBO3))
def combination_3(spark, d):
    return S.data_all(spark, d).select("uid", "aid", *[X.combination(list(c)).alias("_".join(c)) for c in COMBO3])
