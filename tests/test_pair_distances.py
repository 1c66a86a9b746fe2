"""Distances of pairs against shortest paths from every source."""

from pyspark.sql import functions as F

from potamos.operators import graph


def test_against_shortest_paths(spark):
    rows = [(k, k, k // 2 if k % 3 else k // 4, float(k * 37 % 11 + 1)) for k in range(2, 60)] + [(100 + k, k, k * 7 % 60, float(k * 13 % 23 + 1)) for k in range(5, 60, 6) if k != k * 7 % 60]
    lines = spark.createDataFrame(rows, "id long, start_node long, end_node long, length double").withColumns({"component": F.lit(0), "one": F.lit(1.0)})
    sources = spark.createDataFrame([(3,), (17,), (44,), (59,)], "node long")
    want = {}
    for weight in ("length", "one"):
        for r in graph.shortest_paths(lines, sources, weight).collect():
            want.setdefault((r.source, r.node), []).append(r.distance)
    pairs = spark.createDataFrame([(0, *k) for k in want], "component int, a long, b long")
    assert {(r.a, r.b): [r.way, float(r.hops)] for r in graph.pair_distances(lines, pairs).collect()} == want
