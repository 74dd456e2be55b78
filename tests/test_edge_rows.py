"""Literal edge rows (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from ctrkit.functions.formatting import fixed_point
from ctrkit.functions.special import digamma_difference, digamma_np
from ctrkit.functions.tokens import replace_token, replace_token_set, token_count
from ctrkit.operators import clean
from ctrkit.operators import encode as E
from ctrkit.operators import evaluate as V
from ctrkit.operators import smoothing as B
from ctrkit.operators import stats as st
from ctrkit.operators import tokens as T
from ctrkit.sources import files
from ctrkit.sources.profile import PROFILE_KEYS, parse_profiles

CELLS4 = [("f", 1, 10), ("f", 2, 10), ("f", 5, 20), ("f", 0, 5)]


def _cells(spark):
    return spark.createDataFrame(CELLS4, "factor_name string, clicks long, impressions long")


def test_profile_parse_basic(spark):
    lines = spark.createDataFrame([("uid 1|age 3|interest1 4 5 6",)], "value string")
    r = parse_profiles(lines, count_unknown=True).collect()[0]
    assert r["uid"] == 1 and r["age"] == "3" and r["interest1"] == "4 5 6"
    assert all(r[k] == "" for k in PROFILE_KEYS if k not in ("uid", "age", "interest1"))
    assert r["n_unknown_keys"] == 0


def test_profile_repeated_and_unknown_and_first_line(spark):
    lines = spark.createDataFrame([("uid 2|age 3|age 4",), ("uid 3|zzz 1",)], "value string")
    rows = {r["uid"]: r for r in parse_profiles(lines, count_unknown=True).collect()}
    assert rows[2]["age"] == "4"              # last wins
    assert rows[3]["n_unknown_keys"] == 1     # kept, unknown key counted
    assert len(rows) == 2                     # the first record is not lost


def test_empty_null_sentinel_chain(spark):
    df = spark.createDataFrame([("",), (None,), ("0",)], "c string")
    out = clean.null_to_sentinel(clean.empty_to_null(df, ["c"]), ["c"])
    assert [r["c"] for r in out.collect()] == ["-1", "-1", "0"]


def test_recode_label(spark):
    df = spark.createDataFrame([(-1,), (1,), (0,), (None,)], "label long")
    assert [r["label"] for r in clean.recode_label(df).collect()] == [0, 1, 0, None]


def test_ordinal_numeric_and_text(spark):
    num = spark.createDataFrame([("10",), ("9",), ("-1",), ("10",)], "c string")
    coded = E.ordinal_encode(num.withColumn("i", F.monotonically_increasing_id()), ["c"]).orderBy("i")
    assert [r["c_code"] for r in coded.collect()] == [2, 1, 0, 2]
    txt = spark.createDataFrame([("10",), ("9",), ("x",)], "c string")
    coded = E.ordinal_encode(txt, ["c"])
    assert {r["c"]: r["c_code"] for r in coded.collect()} == {"10": 0, "9": 1, "x": 2}


def test_token_counts_blank_and_word(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "-1"), (3, "c b")], "uid long, f string")
    d = {r["val"]: r["code"] for r in E.token_dictionary(df, ["f"]).collect()}
    assert d == {"-1": 0, "a": 1, "b": 2, "c": 3}
    cnt = {(r["uid"], r["code"]): r["count"] for r in E.token_counts_long(df, ["uid"], ["f"]).collect()}
    assert cnt[(1, 1)] == 2 and cnt[(1, 2)] == 1
    w = spark.createDataFrame([(1, "ab a AB"), (2, "-1")], "uid long, f string")
    d = {r["val"]: r["code"] for r in E.token_dictionary(w, ["f"], word=True).collect()}
    assert d == {"ab": 0}
    cnt = E.token_counts_long(w, ["uid"], ["f"], word=True).collect()
    assert [(r["uid"], r["code"], r["count"]) for r in cnt] == [(1, 0, 2)]


def test_token_replace(spark):
    df = spark.createDataFrame([("1 2 2 3",), ("-1",), ("1 12 112",)], "c string")
    out = [r[0] for r in df.select(replace_token_set("c", ["2"])).collect()]
    assert out == ["1 other other 3", "-1", "1 12 112"]
    out = [r[0] for r in df.select(replace_token("c", "12")).collect()]
    assert out[2] == "1 other 112"
    out = [r[0] for r in df.select(replace_token("c", "1")).collect()]
    assert out[1] == "-1"


def test_token_count(spark):
    df = spark.createDataFrame([("-1",), ("7",), ("7 8 9",)], "c string")
    assert [r[0] for r in df.select(token_count("c")).collect()] == [-1, 1, 3]


def test_topn_cut_set(spark):
    imp = spark.createDataFrame([("f", "5", 9), ("f", "6", 9), ("f", "7", 1), ("f", "-1", 99)],
                                "factor_name string, single_value string, import_value long")
    cut = {r["single_value"] for r in T.topn_cut_set(imp, 1).collect()}
    assert cut == {"6", "7"}


def test_cut_tokens_join_path(spark):
    users = spark.createDataFrame([(1, "1 2 2 3"), (2, "-1"), (3, None)], "uid long, kw1 string")
    cut = spark.createDataFrame([("kw1", "2")], "factor_name string, single_value string")
    out = {r["uid"]: r["kw1"] for r in T.cut_tokens(users, ["uid"], ["kw1"], cut).collect()}
    assert out == {1: "1 other other 3", 2: "-1", 3: None}


def test_digamma_difference(spark):
    v = spark.range(1).select(digamma_difference(F.lit(3), F.lit(0.5)).alias("d")).collect()[0]["d"]
    assert abs(v - (1 / 0.5 + 1 / 1.5 + 1 / 2.5)) < 1e-10
    # numpy twin agrees with the finite sum for a range of arguments
    for n, a in [(1, 0.1), (7, 2.5), (100, 13.0)]:
        exact = sum(1.0 / (a + k) for k in range(n))
        assert abs((digamma_np(n + a) - digamma_np(a)) - exact) < 1e-9


def test_beta_one_step(spark):
    hist = B.cell_histogram(_cells(spark), ["factor_name"])
    p0 = spark.createDataFrame([("f", 1.0, 1.0)], "factor_name string, alpha double, beta double")
    r = B.beta_step(hist, p0, ["factor_name"]).collect()[0]
    assert abs(r["alpha"] - 0.587986067478422) < 1e-9 and abs(r["beta"] - 1.3704034821322923) < 1e-9


def test_beta_five_steps_both_paths(spark):
    r = B.fit_beta_steps(_cells(spark), ["factor_name"], 5).collect()[0]
    assert abs(r["alpha"] - 0.568104700667664) < 1e-9 and abs(r["beta"] - 1.9904604406926836) < 1e-9
    r = B.fit_beta(_cells(spark), ["factor_name"], max_iter=5, eps=0.0).collect()[0]
    assert abs(r["alpha"] - 0.568104700667664) < 1e-9 and abs(r["beta"] - 1.9904604406926836) < 1e-9


def test_beta_underdispersed_runs_away(spark):
    r = B.fit_beta(_cells(spark), ["factor_name"]).collect()[0]
    assert abs(r["alpha"] - 41.2083) < 1e-3 and abs(r["beta"] - 191.9710) < 1e-3
    assert r["converged"] is False and r["n_iter"] == 1000


def test_smoothed_values(spark):
    c = spark.createDataFrame([("f", 1, 10)], "factor_name string, clicks long, impressions long")
    p = spark.createDataFrame([("f", 1.0, 1.0)], "factor_name string, alpha double, beta double")
    assert abs(B.smooth(c, p, ["factor_name"], complement=True).collect()[0]["ctr"] - 0.8333333333) < 1e-9
    assert abs(B.smooth(c, p, ["factor_name"]).collect()[0]["ctr"] - 0.1666666667) < 1e-9


def test_noisy_or_product(spark):
    rows = spark.createDataFrame([(1, "f", "a"), (1, "f", "b"), (2, "f", "a"), (2, "f", "z")],
                                 "uid long, factor_name string, single_value string")
    stat = spark.createDataFrame([("f", "a", 0.5), ("f", "b", 0.25), ("f", "z", 0.0)],
                                 "factor_name string, single_value string, q double")
    out = {r["uid"]: r["noisy_or"] for r in st.noisy_or(rows, stat, ["uid"], "q").collect()}
    assert out == {1: 0.125, 2: 0.0}


def test_auc_small_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, label long")
    assert V.auc_exact(df, "s").collect()[0]["auc"] == 0.875
    one = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, label long")
    assert V.auc_exact(one, "s").collect()[0]["auc"] is None


def test_best_round(spark):
    curve = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, 0.6)], "round int, metric double")
    r = V.best_round(curve).collect()[0]
    assert r["best_round"] == 1 and r["best_metric"] == 0.7


def test_fixed_point_format(spark):
    df = spark.createDataFrame([(0.123456789,), (None,)], "s double")
    assert [r[0] for r in df.select(fixed_point("s")).collect()] == ["0.12345679", None]


def test_overwrite_one_partition(spark, tmp_path):
    from ctrkit.session import scratch_path
    path = scratch_path(spark, "s12-test")
    rows = [("f0", i) for i in range(34)] + [("f1", i) for i in range(33)] + [("f2", i) for i in range(33)]
    files.write_partitioned(spark.createDataFrame(rows, "factor_name string, v long"), path)
    files.overwrite_partitions(spark.createDataFrame([("f1", 1), ("f1", 2)], "factor_name string, v long"), path)
    got = {r["factor_name"]: r["count"] for r in spark.read.parquet(path).groupBy("factor_name").count().collect()}
    assert got == {"f0": 34, "f1": 2, "f2": 33}
