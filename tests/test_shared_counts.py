"""Statistics mapped back to rows that are moved once, hot values and codes of long texts included."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctrkit.operators import stats as st
from ctrkit.operators.smoothing import fit_and_smooth
from ctrkit.plans import standin as S
from tests.conftest import SF001

LONG = "a text that is longer than a code "


@pytest.fixture()
def rows(spark):
    data = [(i, None if i % 11 == 0 else i % 3, [None, 0, 1][i % 3], f"b{i % 2}", None if i % 7 == 0 else LONG + str(i % 5), f"s{i % 2}")
            for i in range(120)]
    return spark.createDataFrame(data, "uid long, aid long, label long, brand string, words string, os string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("hot", [10 ** 6, 5])
def test_counts_with_hot_and_null_values(rows, monkeypatch, hot):
    monkeypatch.setattr(st, "HOT_ROWS", hot)
    all_rows = rows.collect()
    got = {r.uid: r for r in st.combination_count(rows, ["words", "os"], "aid").collect()}
    assert len(got) == len(all_rows)
    for f in ("words", "os"):
        n = Counter((r[f], r.aid) for r in all_rows)
        for r in all_rows:
            assert got[r.uid][f"{f}_aid_cnt"] == (None if r.aid is None or r[f] is None else n[r[f], r.aid])


@pytest.mark.parametrize("hot", [10 ** 6, 5])
def test_pairs_of_many_values_are_those_of_few(rows, monkeypatch, hot):
    few = sorted(map(tuple, st.pair_statistics(rows, ["brand"], ["words", "os"]).collect()), key=str)
    assert any(r[2] is None for r in few) and any(r[2] for r in few)
    monkeypatch.setattr(st, "SMALL_TABLE", 0)
    monkeypatch.setattr(st, "HOT_ROWS", hot)
    assert sorted(map(tuple, st.pair_statistics(rows, ["brand"], ["words", "os"]).collect()), key=str) == few


def test_tables_of_pairs_are_the_pairs(rows, monkeypatch):
    monkeypatch.setattr(st, "SMALL_TABLE", 6)
    keyed = rows.where("aid is not null")
    base, tables = st.pair_tables(keyed, ["brand"], ["words", "os"])
    got = sorted(map(tuple, st.attach_bucketed(base, tables).collect()))
    assert len(tables) == 2 and got == sorted(map(tuple, st.pair_statistics(keyed, ["brand"], ["words", "os"]).collect()))
    st.drop_bucketed(rows.sparkSession)


def test_texts_of_one_code_stay(rows, monkeypatch):
    assert st.coded(rows, ["words", "os"]).schema["words"].dataType.typeName() == "long"
    monkeypatch.setattr(st.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    assert st.coded(rows, ["words", "os"]).schema["words"].dataType.typeName() == "string"


def test_combination_counts_move_the_rows_once(spark):
    out = st.combination_count(S.data_all(spark, SF001), S.USER_COLS)
    out.collect()
    assert _plan(out).count("Exchange") - _plan(out).count("BroadcastExchange") == 1


def test_parameters_meet_cells_where_they_lie(spark):
    cells = st.ctr_by_value_aid(S.labelled(spark, SF001), S.CROSS_FACTORS).drop("ctr")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(fit_and_smooth(cells, ["factor_name"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_crosses_with_a_common_key_move_combinations(spark):
    lab = S.labelled(spark, SF001)
    out = st.cross_ctr(lab, [("lbs", "house", "aid"), ("carrier", "house", "aid")])
    plain = {("lbs_house_aid", *map(str, r[:3]), r[3], r[4]) for r in
             lab.groupBy("lbs", "house", "aid").agg(F.sum("label"), F.count("*")).collect()}
    assert {tuple(r)[:-1] for r in out.where("cross_name = 'lbs_house_aid'").collect()} == plain
    plan = _plan(out)
    assert plan.index("Exchange") > plan.index("Generate")


def test_profiles_collect_whole_sets_once(spark):
    S.users(spark, SF001)
    df = S.user_profiles(spark, SF001)
    plan = _plan(df)
    at = plan.index("collect_set")
    assert "partial_collect_set" in plan and "Exchange" not in plan[at:plan.index("partial_collect_set")]
