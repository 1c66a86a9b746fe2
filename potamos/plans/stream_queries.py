"""Streaming additions."""

from __future__ import annotations

from pyspark.sql import functions as F

from potamos.plans.registry import query
from potamos.streaming.events import run_available, windowed


@query("x_stream_filter", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def _(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return run_available(stream.where("value > 50").select("event_id", "event_type", "value"))


@query("x_window_batch", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def _(t):
    return windowed(t.events).withColumn("start", F.col("start").cast("timestamp"))
