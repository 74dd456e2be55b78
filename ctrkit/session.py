"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults a job of this library wants; a cluster's own settings win when present.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the driver drops the DataFrame that they belong to.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast is chosen by Spark from measured sizes (AQE runtime stats), never forced
    # on a side whose size grows with the data.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = None, app_name: str = "ctrkit",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder shared by all executors: the session's checkpoint directory.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master (tests) gets a private
    folder when the session has none; on a cluster the missing setting is an error, because a
    folder of the driver's machine is not seen by the executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d is None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
        if not conf_dir:
            if not is_local(sc.master):
                raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {sc.master}")
            conf_dir = tempfile.mkdtemp(prefix="ctrkit-ckpt-")
        sc.setCheckpointDir(conf_dir)
        d = sc.getCheckpointDir()
    return d


def is_local(master: str) -> bool:
    """Whether driver and executors are one machine."""
    return master == "local" or master.startswith(("local[", "local-cluster["))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table. The folder belongs
    to the session and goes with it: see ``drop_scratch``."""
    path = f"{shared_root(spark).rstrip('/')}/ctrkit-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete every intermediate table written so far in this process; returns how many. Results
    that still read them must have been written or consumed before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
