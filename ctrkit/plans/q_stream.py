"""Streaming form of the click / impression statistics over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctrkit.plans.catalog import register
from ctrkit.session import scratch_path
from ctrkit.streaming.counts import read_counts, run_incremental_counts

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@register("stream_click_stats", """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:00:00') AS hour,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
       round(CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE)
             / nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0), 6) AS ctr
FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d %H:00:00')
""")
def stream_click_stats(spark, d):
    """Clicks and views per (user, event hour) maintained by a Structured Streaming
    query over the event files, drained with ``availableNow``."""
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        f"{d.rstrip('/')}/events*.parquet").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH:00:00"))
    out, ckpt = scratch_path(spark, "stream-counts"), scratch_path(spark, "stream-ckpt")
    run_incremental_counts(spark, src, ["user_id", "hour"], F.col("event_type") == "click",
                           F.col("event_type") == "view", out, ckpt)
    res = read_counts(spark, out, ["user_id", "hour"])
    return res.select("user_id", "hour", "clicks", "impressions", F.round("ctr", 6).alias("ctr"))
