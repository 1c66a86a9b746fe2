"""Settled tables are broadcast by their rows, not by the size of their compressed files."""

from pyspark.sql import functions as F

from potamos.operators.lineage import Rounds, settle


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compressed_tables_are_not_broadcast(spark):
    rows = spark.range(0, 3_000_000, 1, 8).select((F.col("id") % 1000).alias("x"), F.floor(F.col("id") / 1000).alias("y"))
    large, log = settle(rows), Rounds(spark)
    log.add(rows)
    other = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("event_id") % 1000).alias("x"))
    for table in (large, log.all(), large.where("y > 5").select("x"), large.union(log.all().select("x", "y")).groupBy("x").agg(F.min("y").alias("y"))):
        assert "BroadcastHashJoin" not in _plan(table.join(table.select("x"), "x", "left_semi"))
        assert "BroadcastHashJoin" in _plan(table.join(other, "x"))  # the small side still is
    assert "BroadcastHashJoin" in _plan(other.join(settle(other.distinct()), "x", "left_semi"))
    assert large.count() == 3_000_000 and large.columns == ["x", "y"]
