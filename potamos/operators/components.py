"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set, to see whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each end of an edge, component being the smallest node id reachable.

    Large-star and small-star rounds until nothing changes: about log(n) rounds of two joins each on the edge list
    alone, whatever the diameter. A hub meets its neighbours in a join, which Spark can split, never in one group.
    Edges with a null end and repeated edges are ignored; a self loop makes its node a component of its own."""
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    star = pairs.where("u <> v")
    before = _state(star)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settle(small.union(least).distinct(), star)
        after = _state(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    joined = found.unionByName(roots)
    return joined.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
