"""Points on the edge of a polygon."""

from potamos.operators import geometry


def test_points_on_a_ring_are_out(spark):
    ring = spark.sql("SELECT 5L AS id, array(struct(0D AS x, -3D AS y), struct(7D AS x, 0D AS y), struct(0D AS x, 3D AS y), struct(-7D AS x, 0D AS y)) AS ring")
    points = spark.createDataFrame([(x * 100 + y, float(x), float(y)) for x in range(-8, 9) for y in range(-4, 5)], "id long, x double, y double")
    found = {r.id for r in geometry.points_in_polygons(points, ring, 4.0).collect()}
    assert found == {x * 100 + y for x in range(-8, 9) for y in range(-4, 5) if abs(x) * 3 + abs(y) * 7 < 21}
