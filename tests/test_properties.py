"""Properties: row-count preservation, dense codes, one-hot shape, CTR bounds, AUC
symmetry, long-form vs per-feature equivalence, distributed scan vs plain window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctrkit.operators import encode as E
from ctrkit.operators import evaluate as V
from ctrkit.operators import stats as st
from ctrkit.operators.ranking import ordered_scan
from ctrkit.operators.smoothing import fit_beta, smooth
from ctrkit.plans import standin as S
from tests.conftest import SF001, SF01


def test_lookups_preserve_rows(spark):
    data = S.data_all(spark, SF001)
    n = data.count()
    x = st.cross_ctr(data, [("lbs", "aid")]).select(F.col("v1").alias("lbs"), F.col("v2").cast("bigint").alias("aid"),
                                                  "corr_ctr")
    assert st.lookup(data, x, ["lbs", "aid"]).count() == n
    assert st.lookup(data, st.delivery_volume(data), ["aid"]).count() == n
    cells = st.ctr_by_value_aid(data, S.CROSS_FACTORS)
    assert st.attach_long(data, ["uid", "aid"], S.CROSS_FACTORS, cells, "ctr").count() == n


def test_codes_dense(spark):
    data = S.data_all(spark, SF001)
    d = E.ordinal_dictionary(data, ["lbs", "carrier", "advertiserid"])
    per = d.groupBy("feature").agg(F.min("code").alias("lo"), F.max("code").alias("hi"),
                                   F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("nd")).collect()
    for r in per:
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["nd"] == r["n"]


def test_one_hot_one_cell_per_block(spark):
    data = S.data_all(spark, SF001)
    cols = ["lbs", "carrier", "producttype"]
    cells = E.one_hot_long(data, ["uid", "aid"], cols)
    per_row = cells.groupBy("uid", "aid").count().select(F.min("count"), F.max("count")).collect()[0]
    assert tuple(per_row) == (3, 3)
    assert cells.count() == data.count() * 3


def test_smoothed_ctr_in_unit_interval(spark):
    cells = st.ctr_by_value_aid(S.labelled(spark, SF001), S.CROSS_FACTORS).drop("ctr")
    sm = smooth(cells, fit_beta(cells, ["factor_name"], max_iter=20, eps=0.0), ["factor_name"])
    r = sm.agg(F.min("ctr"), F.max("ctr")).collect()[0]
    assert 0.0 < r[0] and r[1] < 1.0


def test_auc_symmetry(spark):
    docs = S.documents_labelled(spark, SF001)
    a = V.auc_exact(docs, "distinct_ratio").collect()[0]["auc"]
    b = V.auc_exact(docs.withColumn("neg", -F.col("distinct_ratio")), "neg").collect()[0]["auc"]
    assert abs(a + b - 1.0) < 1e-12


def test_long_form_equals_per_feature(spark):
    lab = S.labelled(spark, SF001)
    long = st.ctr_by_value_aid(lab, ["lbs", "carrier"])
    for f in ["lbs", "carrier"]:
        one = st.click_stats(lab, [f, "aid"]).select(F.col(f).alias("value"), "aid", "clicks", "impressions")
        mine = long.where(F.col("factor_name") == f).select("value", "aid", "clicks", "impressions")
        assert one.exceptAll(mine).count() == 0 and mine.exceptAll(one).count() == 0


def test_ordered_scan_matches_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.randint(0, 40), rnd.random(), rnd.randint(0, 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, tie double, v long")
    got = ordered_scan(df, [F.col("k").desc(), F.col("tie").asc()], ["g"], sums=["v"], index_col="i", num_slices=7)
    w = Window.partitionBy("g").orderBy(F.col("k").desc(), F.col("tie").asc())
    want = df.select("g", "k", "tie", (F.row_number().over(w) - 1).alias("i"),
                     F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                     .alias("v_before"))
    a = got.select("g", "k", "tie", "i", "v_before")
    assert a.exceptAll(want).count() == 0 and want.exceptAll(a).count() == 0


def test_documents_auc_known_value(spark):
    out = {r["feature"]: r["auc"] for r in
           V.auc_exact(S.documents_labelled(spark, SF01), "distinct_ratio", "label").select(
               F.lit("distinct_ratio").alias("feature"), "auc").collect()}
    assert abs(out["distinct_ratio"] - 0.861892) < 1e-6


def test_fit_golden_sf001(spark):
    """Cells c_nationkey x p_brand over every lineitem row, click = 'R', 200 updates."""
    li = S.table(spark, SF01, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag"])
    o = S.table(spark, SF01, "orders", ["o_orderkey", "o_custkey"])
    c = S.table(spark, SF01, "customer", ["c_custkey", "c_nationkey"])
    p = S.table(spark, SF01, "part", ["p_partkey", "p_brand"])
    rows = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.lit("nation_brand").alias("factor_name"), "c_nationkey", "p_brand",
                    (F.col("l_returnflag") == "R").cast("long").alias("label")))
    cells = st.click_stats(rows, ["factor_name", "c_nationkey", "p_brand"], ctr=None)
    r = fit_beta(cells, ["factor_name"], max_iter=200, eps=0.0).collect()[0]
    assert abs(r["alpha"] - 13.5991962534) < 1e-6 and abs(r["beta"] - 26.7298716608) < 1e-6


def test_lookups_by_factor_equal_one_long_join(spark):
    data = S.data_all(spark, SF001)
    cells = st.ctr_by_value_aid(data, S.CROSS_FACTORS)
    a = st.attach_long(data, ["uid", "aid"], S.CROSS_FACTORS, cells, "ctr", suffix="_c")
    lf = st.long_form(data, S.CROSS_FACTORS, ["uid", "aid"]).join(cells, ["factor_name", "value", "aid"], "left")
    b = lf.groupBy("uid", "aid").pivot("factor_name", S.CROSS_FACTORS).agg(F.first("ctr")).select(
        "uid", "aid", *[F.col(f).alias(f"{f}_c") for f in S.CROSS_FACTORS])
    assert a.count() == b.count() == data.count()
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_auc_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("xy"), float(rnd.randint(0, 12)), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, label long")
    got = {r["g"]: r["auc"] for r in V.auc_exact(df, "s", "label", ["g"]).collect()}
    for g in "xy":
        pos = [s for gg, s, y in rows if gg == g and y == 1]
        neg = [s for gg, s, y in rows if gg == g and y == 0]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-12
