"""Windowed aggregates over an event stream. An addition of our own: the batch operators know no time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potamos.operators.lineage import shared_dir


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and highest value per window and type, for batches and streams alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    agg = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "top")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into Parquet on shared storage and give it back as a batch."""
    spark, root = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    sink.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
