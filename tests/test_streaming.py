"""Streaming partial counts: totals equal the batch answer, and a replayed batch (a
new checkpoint restarts batch ids) overwrites its partial instead of double counting."""

from pyspark.sql import functions as F

from ctrkit.plans.q_stream import EVENT_SCHEMA
from ctrkit.session import scratch_path
from ctrkit.streaming.counts import read_counts, run_incremental_counts
from tests.conftest import SF001


def _run(spark, out, ckpt):
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{SF001}/events*.parquet")
    run_incremental_counts(spark, src, ["user_id"], F.col("event_type") == "click", F.col("event_type") == "view",
                           out, ckpt)


def test_stream_totals_and_replay(spark):
    out = scratch_path(spark, "stream-test-out")
    _run(spark, out, scratch_path(spark, "stream-test-ck"))
    first = {r["user_id"]: (r["clicks"], r["impressions"]) for r in read_counts(spark, out, ["user_id"]).collect()}
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    want = {r["user_id"]: (r["c"], r["v"]) for r in ev.groupBy("user_id").agg(
        F.sum((F.col("event_type") == "click").cast("long")).alias("c"),
        F.sum((F.col("event_type") == "view").cast("long")).alias("v")).collect()}
    assert first == want
    _run(spark, out, scratch_path(spark, "stream-test-ck2"))   # replay from scratch
    again = {r["user_id"]: (r["clicks"], r["impressions"]) for r in read_counts(spark, out, ["user_id"]).collect()}
    assert again == want
