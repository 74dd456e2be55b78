"""Encoder queries: ordinal codes, joint encode + split, one-hot cells, token counts,
column dictionary, assembled design matrix."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from ctrkit.operators import encode as E
from ctrkit.operators import instances
from ctrkit.plans import standin as S
from ctrkit.plans.catalog import register
from ctrkit.plans.oracle_base import unpivot_sql, with_base
from ctrkit.plans.q_tokens import _users_filled
from ctrkit.session import scratch_path

ORD_COLS = ["lbs", "consumptionability", "carrier", "advertiserid"]
OHE_COLS = ["lbs", "carrier", "producttype"]
TOKEN_FIELDS = ["kw1", "interest1", "os"]
DICT_TOKENS = ["kw1", "interest1"]


def _dict_sql(cols, source="data", name="dict"):
    return [
        f"{name}_vals AS (SELECT DISTINCT factor_name AS feature, value AS val FROM ("
        f"{unpivot_sql(source, [], cols)}) WHERE value IS NOT NULL)",
        f"{name}_ints AS (SELECT feature, val, CASE WHEN regexp_full_match(val, '[+-]?[0-9]+') THEN "
        f"TRY_CAST(val AS BIGINT) END AS i FROM {name}_vals)",
        f"{name} AS (SELECT feature, val, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY "
        f"CASE WHEN num THEN i END NULLS LAST, CASE WHEN num THEN '' ELSE val END) - 1 AS BIGINT) AS code FROM ("
        f"SELECT *, bool_and(i IS NOT NULL) OVER (PARTITION BY feature) AS num FROM {name}_ints))"]


def _offsets_sql(order, dict_name, name):
    pos = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(order)) + " END"
    return (f"{name} AS (SELECT feature, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND "
            f"1 PRECEDING), 0) AS off FROM (SELECT feature, count(*) AS n, {pos} AS pos FROM {dict_name} "
            f"GROUP BY feature))")


@register("ordinal_encode", with_base(*_dict_sql(ORD_COLS), select=(
    "SELECT d.uid, d.aid, " + ", ".join(f"c_{c}.code AS {c}_code" for c in ORD_COLS) + " FROM data d " +
    " ".join(f"LEFT JOIN (SELECT val, code FROM dict WHERE feature = '{c}') c_{c} ON d.{c} = c_{c}.val"
             for c in ORD_COLS))))
def ordinal_encode(spark, d):
    out = E.ordinal_encode(S.data_all(spark, d), ORD_COLS)
    return out.select("uid", "aid", *[f"{c}_code" for c in ORD_COLS])


@register("joint_encode_split", with_base(
    "u AS (SELECT aid, uid, lbs, carrier, CASE WHEN label IS NULL THEN 2 ELSE 1 END AS qubie FROM data)",
    *_dict_sql(["lbs", "carrier"], "u"),
    select="SELECT u.aid, u.uid, CAST(u.qubie AS INTEGER) AS qubie, a.code AS lbs_code, b.code AS carrier_code FROM u "
           "LEFT JOIN (SELECT val, code FROM dict WHERE feature = 'lbs') a ON u.lbs = a.val "
           "LEFT JOIN (SELECT val, code FROM dict WHERE feature = 'carrier') b ON u.carrier = b.val"))
def joint_encode_split(spark, d):
    """U4: train and test encoded with one dictionary, told apart by the origin flag."""
    data = S.data_all(spark, d)
    both = instances.union_sources({1: data.where(F.col("label").isNotNull()), 2: data.where(F.col("label").isNull())},
                                   "qubie")
    out = E.ordinal_encode(both, ["lbs", "carrier"])
    return out.select("aid", "uid", "qubie", "lbs_code", "carrier_code")


@register("one_hot_long", with_base(*_dict_sql(OHE_COLS), _offsets_sql(OHE_COLS, "dict", "offs"),
                                    f"lf AS ({unpivot_sql('data', ['uid', 'aid'], OHE_COLS)})", select=(
    "SELECT l.uid, l.aid, CAST(o.off + c.code AS BIGINT) AS col_index, 1.0 AS value FROM lf l "
    "JOIN dict c ON l.factor_name = c.feature AND l.value = c.val JOIN offs o ON c.feature = o.feature")))
def one_hot_long(spark, d):
    return E.one_hot_long(S.data_all(spark, d), ["uid", "aid"], OHE_COLS)


def _tok_dict_sql(fields, source, word=False, name="tdict"):
    tok = (lambda f: f"regexp_extract_all(lower({f}), '\\b\\w\\w+\\b')") if word else \
        (lambda f: f"string_split(lower({f}), ' ')")
    vals = " UNION ".join(f"SELECT DISTINCT '{f}' AS feature, unnest({tok(f)}) AS val FROM {source} "
                          f"WHERE {f} IS NOT NULL" for f in fields)
    ex = " UNION ALL ".join(f"SELECT uid, '{f}' AS feature, unnest({tok(f)}) AS val FROM {source} "
                            f"WHERE {f} IS NOT NULL" for f in fields)
    return [f"{name} AS (SELECT feature, val, CAST(row_number() OVER (PARTITION BY feature ORDER BY val) - 1 AS BIGINT)"
            f" AS code FROM ({vals}))",
            f"{name}_ex AS ({ex})"]


_UF = ("uf AS (SELECT uid, coalesce(kw1, '-1') AS kw1, coalesce(interest1, '-1') AS interest1, "
       "coalesce(os, '-1') AS os FROM users WHERE uid IN (SELECT uid FROM data))")


def _tok_counts_sql(word):
    return with_base(_UF, *_tok_dict_sql(TOKEN_FIELDS, "uf", word), select=(
        "SELECT e.uid, e.feature, t.code, count(*) AS count FROM tdict_ex e JOIN tdict t "
        "ON e.feature = t.feature AND e.val = t.val GROUP BY e.uid, e.feature, t.code"))


@register("token_counts", _tok_counts_sql(False))
def token_counts(spark, d):
    """Blank tokenizer, lower-cased, ``-1`` is a token, alphabetical vocabulary."""
    u = _users_filled(spark, d).select("uid", *TOKEN_FIELDS)
    return E.token_counts_long(u, ["uid"], TOKEN_FIELDS)


@register("token_counts_word", _tok_counts_sql(True))
def token_counts_word(spark, d):
    """Default word tokenizer (2+ word characters): ``-1`` and 1-letter ids vanish."""
    u = _users_filled(spark, d).select("uid", *TOKEN_FIELDS)
    return E.token_counts_long(u, ["uid"], TOKEN_FIELDS, word=True)


NUMERIC_COLS = ["creativesize_num"]
# Every column of the matrix: one-hot classes, token vocabularies, then the numeric column.
_MATRIX_CTES = [
    *_dict_sql(OHE_COLS),
    "tdict AS (SELECT feature, val, CAST(row_number() OVER (PARTITION BY feature ORDER BY val) - 1 AS BIGINT) AS code "
    "FROM (" + " UNION ".join(f"SELECT DISTINCT '{f}' AS feature, unnest(string_split(lower({f}), ' ')) AS val "
                              f"FROM data WHERE {f} IS NOT NULL" for f in DICT_TOKENS) + "))",
    "blocks AS (SELECT feature, val, code FROM dict UNION ALL SELECT feature, val, code FROM tdict "
    "UNION ALL SELECT 'creativesize_num', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT))",
    _offsets_sql(OHE_COLS + DICT_TOKENS + NUMERIC_COLS, "blocks", "offs"),
    "fdict AS (SELECT b.feature, b.val, CAST(o.off + b.code AS BIGINT) AS col_index FROM blocks b "
    "JOIN offs o ON b.feature = o.feature)"]
_CELLS_SQL = " UNION ALL ".join([
    f"SELECT l.uid, l.aid, f.col_index, 1.0 AS value FROM ({unpivot_sql('data', ['uid', 'aid'], OHE_COLS)}) l "
    f"JOIN fdict f ON l.factor_name = f.feature AND l.value = f.val",
    *[f"SELECT t.uid, t.aid, f.col_index, CAST(count(*) AS DOUBLE) AS value FROM (SELECT uid, aid, "
      f"unnest(string_split(lower({c}), ' ')) AS val FROM data WHERE {c} IS NOT NULL) t JOIN fdict f "
      f"ON f.feature = '{c}' AND t.val = f.val GROUP BY t.uid, t.aid, f.col_index" for c in DICT_TOKENS],
    "SELECT d.uid, d.aid, f.col_index, CAST(d.creativesize AS DOUBLE) AS value FROM data d "
    "JOIN fdict f ON f.feature = 'creativesize_num' WHERE CAST(d.creativesize AS DOUBLE) <> 0"])


def matrix_input(spark, d):
    return S.data_all(spark, d).withColumn("creativesize_num", F.col("creativesize").cast("double"))


@register("feature_dictionary", with_base(*_MATRIX_CTES, select="SELECT * FROM fdict"))
def feature_dictionary(spark, d):
    return E.feature_dictionary(matrix_input(spark, d), OHE_COLS, DICT_TOKENS, NUMERIC_COLS)


@register("dictionary_roundtrip", with_base(*_MATRIX_CTES, select=(
    "SELECT feature, count(*) AS n, min(col_index) AS first_col, max(col_index) AS last_col FROM fdict GROUP BY feature")))
def dictionary_roundtrip(spark, d):
    """The dictionary written and read back, as each block's extent."""
    path = scratch_path(spark, "dictionary")
    E.save_dictionary(feature_dictionary(spark, d), path)
    return E.load_dictionary(spark, path).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("col_index").alias("first_col"), F.max("col_index").alias("last_col"))


def design_rows(spark, d):
    """(uid, aid, label, features) and the dictionary of the columns."""
    return E.design_matrix(matrix_input(spark, d), ["uid", "aid"], OHE_COLS, DICT_TOKENS, NUMERIC_COLS)


def vector_cells(rows, features: str = "features"):
    """(uid, aid, col_index, value) of the stored values of sparse vectors."""
    parts = rows.select("uid", "aid", unwrap_udt(features).alias("_v"))
    return parts.select("uid", "aid", F.explode(F.arrays_zip("_v.indices", "_v.values")).alias("_c")).select(
        "uid", "aid", F.col("_c.indices").cast("bigint").alias("col_index"), F.col("_c.values").alias("value"))


@register("design_cells", with_base(*_MATRIX_CTES, select=_CELLS_SQL))
def design_cells(spark, d):
    """E5-E7 in long form (V), taken from the assembled vectors."""
    rows, _ = design_rows(spark, d)
    return vector_cells(rows)


@register("design_matrix", with_base(
    *_MATRIX_CTES, f"cells AS ({_CELLS_SQL})",
    select="SELECT d.aid, d.uid, d.label, CAST((SELECT max(col_index) + 1 FROM fdict) AS INTEGER) AS n_features, "
           "CAST(coalesce(c.nnz, 0) AS INTEGER) AS nnz FROM data d LEFT JOIN (SELECT uid, aid, count(*) AS nnz "
           "FROM cells GROUP BY uid, aid) c ON d.uid = c.uid AND d.aid = c.aid"))
def design_matrix(spark, d):
    """Assembled sparse rows; width and stored values of each."""
    rows, _ = design_rows(spark, d)
    v = unwrap_udt("features")
    return rows.select("aid", "uid", "label", v["size"].alias("n_features"), F.size(v["indices"]).alias("nnz"))
