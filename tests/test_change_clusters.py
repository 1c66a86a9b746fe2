"""Clusters of class changes: places meet once, however many vertices stand there."""

import math

from potamos.operators import rasters


def _want(rows, apart):
    lines, points = {}, []
    for r in rows:
        lines.setdefault(r[0], []).append(r)
    for line in lines.values():
        line.sort(key=lambda r: r[1])
        points += [(r, k not in (0, len(line) - 1)) for k, r in enumerate(line) if k in (0, len(line) - 1) or r[4] != line[k - 1][4]]
    root = list(range(len(points)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, _) in enumerate(points):
        for j, (b, _) in enumerate(points[:i]):
            if math.dist(a[2:4], b[2:4]) <= apart:
                root[top(i)] = top(j)
    groups = {}
    for k, p in enumerate(points):
        groups.setdefault(top(k), []).append(p)
    return sorted(min(p[0][:4] for p in g) for g in groups.values() if all(c for _, c in g))


def test_against_all_pairs(spark):
    rows = [(i, p, float(i * 7919 % 900 + p * (60 + i % 50)), float(i * 104729 % 700 - p * 37), i * p % 3) for i in range(60) for p in range(i % 6 + 2)]
    found = rasters.class_change_nodes(spark.createDataFrame(rows, "id long, pos int, x double, y double, class int"), 25.0)
    assert sorted(tuple(r) for r in found.collect()) == _want(rows, 25.0)


def test_many_vertices_at_few_places(spark):
    """60,000 vertices at 3 places: with all pairs of them this took billions of rows."""
    frame = spark.range(20_000).selectExpr("id", "explode(array(0, 1, 2)) AS pos").selectExpr("id", "pos", "pos * 500D AS x", "0D AS y", "pos AS class")
    assert [tuple(r) for r in rasters.class_change_nodes(frame, 90.0).collect()] == [(0, 1, 500.0, 0.0)]
