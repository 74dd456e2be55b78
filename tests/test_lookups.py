"""Column concat by row keys, and many lookups on bucketed tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ctrkit.operators import instances
from ctrkit.operators import stats as st
from ctrkit.plans import standin as S
from tests.conftest import SF001


def _two(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (None, "c", 3.0)], "id long, k string, x double")
    right = spark.createDataFrame([(None, "c", "z"), (1, "a", None), (2, None, "y")], "id long, k string, y string")
    return left, right


def test_column_concat_aligns_rows_by_key(spark):
    left, right = _two(spark)
    got = {tuple(r) for r in instances.column_concat(left, right, ["id", "k"]).collect()}
    assert got == {(1, "a", 1.0, None), (2, None, 2.0, "y"), (None, "c", 3.0, "z")}


def test_column_concat_brings_rows_together_before_it_counts_them(spark):
    left, right = _two(spark)
    plan = instances.column_concat(left, right, ["id", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1


def test_column_concat_of_empty_tables(spark):
    left, right = _two(spark)
    assert instances.column_concat(left.where("false"), right.where("false"), ["id", "k"]).collect() == []


@pytest.mark.parametrize("change", ["missing left", "missing right", "twice"])
def test_column_concat_refuses_other_rows(spark, change):
    left, right = _two(spark)
    if change == "missing left":
        left = left.where("id = 1")
    elif change == "missing right":
        right = right.where("id = 1")
    else:
        right = right.unionByName(right.where("id = 1"))
    with pytest.raises(PySparkException, match="do not have the same rows"):
        instances.column_concat(left, right, ["id", "k"]).collect()


def test_many_lookups_move_no_row(spark):
    data = S.data_all(spark, SF001).select("uid", "aid", "lbs", "carrier")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        rows = st.bucketed(data.select("uid", "aid"), ["uid", "aid"], "rows", 4)
        stats = [st.bucketed(data.where(F.col("aid") % 7 != i % 7).select("uid", "aid", (F.col("aid") * i).alias(f"s{i}")),
                             ["uid", "aid"], "one", 4) for i in range(42)]
        plan = st.attach_bucketed(rows, stats, at_once=42)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 42 and "Exchange" not in plan
        out = st.attach_bucketed(rows, stats, buckets=4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= st.LOOKUPS_AT_ONCE and "Exchange" not in plan
        got = out.collect()
        assert len(got) == data.count()
        assert all(r[f"s{i}"] == (r.aid * i if r.aid % 7 != i % 7 else None) for r in got for i in range(42))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        st.drop_bucketed(spark)


def test_a_stored_statistic_has_few_files(spark):
    import re
    from urllib.parse import urlparse
    from pathlib import Path

    stats = st.ctr_by_value_aid(S.labelled(spark, SF001), S.CROSS_FACTORS).repartition(16, "aid")
    table = st.by_factor(stats)
    files = [urlparse(f).path for f in table.inputFiles()]
    assert len(files) <= 2 * len(S.CROSS_FACTORS)
    assert {re.search("factor_name=(.*)", Path(f).parent.name)[1] for f in files} == set(S.CROSS_FACTORS)


def test_prepared_inputs_are_looked_up_without_a_job(spark):
    S.data_all(spark, SF001)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("again", "")
    S.sources_at(spark, SF001)
    assert list(tracker.getJobIdsForGroup("again")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rewritten_inputs_are_prepared_anew(spark, tmp_path):
    import os
    import shutil
    for t in ("lineitem", "orders", "customer", "nation", "part"):
        shutil.copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    before = S.sources_at(spark, str(tmp_path))
    assert S.sources_at(spark, str(tmp_path)) == before
    os.utime(tmp_path / "part.parquet", (1, 1))
    assert S.sources_at(spark, str(tmp_path)) != before
