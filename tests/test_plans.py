"""Plan shape: no cartesian products, no row-at-a-time Python in SQL-checked queries,
scans pruned to the needed columns."""

import pytest

from tests.conftest import SF001

SAMPLE = ["smoothed_ctr_auc", "instance_join", "lookup_batch", "attach_smoothed_ctr", "cross_ctr_3",
          "pair_statistics", "combination_count", "topn_cut_set", "ordinal_encode", "auc_exact", "roc_points",
          "token_noisy_or"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cartesian_no_python_udf(spark, name):
    from __spark_entry__ import queries
    plan = _plan(queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark):
    from ctrkit.plans import standin as S
    plan = _plan(S.train_instances(spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string>" in plan
    assert "l_extendedprice" not in plan


def _scans(df):
    """(number of file scans in the executed plan, its text)."""
    df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    return plan.count("FileScan"), plan


@pytest.mark.parametrize("name,lookups", [("lookup_batch", 5), ("attach_smoothed_ctr", 5), ("combination_count", 7),
                                          ("pair_statistics", 21)])
def test_statistics_are_aggregated_once(spark, name, lookups):
    """The result reads the instances once and each statistic from its own partition: nothing is
    unpivoted, exploded or aggregated per lookup."""
    from __spark_entry__ import queries
    scans, plan = _scans(queries()[name](spark, SF001))
    assert scans <= lookups + 1
    assert "Expand" not in plan and "Generate" not in plan and "HashAggregate" not in plan


def test_cells_of_a_fit_are_aggregated_once(spark):
    from __spark_entry__ import queries
    scans, plan = _scans(queries()["smoothed_ctr_all"](spark, SF001))
    assert scans == 0 and "Expand" not in plan  # the cells come from the checkpoint
