"""The shared folder: named by the cluster, private only on a local master; scratch goes away."""

import os

import pytest

from ctrkit import session


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


class Session:
    sparkContext = Context()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


@pytest.mark.parametrize("master,local", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", True),
                                          ("yarn", False), ("k8s://localhost", False), ("localhost:7077", False)])
def test_local_masters(master, local):
    assert session.is_local(master) is local


def test_scratch_tables_are_dropped(spark):
    kept = list(session._SCRATCH)
    session._SCRATCH.clear()
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    at = path.removeprefix("file:")
    assert os.path.isdir(at)
    assert session.drop_scratch(spark) == 1 and not os.path.exists(at)
    session._SCRATCH.extend(kept)
