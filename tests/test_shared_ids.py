"""Lines that share an id."""

from pyspark.sql import functions as F

from potamos.operators import graph


def test_route_takes_rows_of_one_id_as_lines_of_their_own(spark):
    lines = spark.createDataFrame([(7, 1, 2, 1.0), (7, 2, 3, 1.0), (8, 3, 3, 1.0), (8, 3, 4, 3.0)], "id long, start_node long, end_node long, width double")
    ones = spark.createDataFrame([(n, 1.0) for n in range(1, 5)], "node long, value double")
    routed, nodes = graph.route(lines, ones, lines.select("id", F.lit(10.0).alias("value")))
    assert sorted(tuple(r) for r in routed.collect()) == [(7, 1.0, 11.0), (7, 12.0, 22.0), (8, 0.25, 10.25), (8, 24.9375, 34.9375)]
    assert {r.node: r.node_in for r in nodes.collect()} == {1: 1.0, 2: 12.0, 3: 33.25, 4: 34.9375}
