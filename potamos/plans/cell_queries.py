"""Queries over map algebra: local, focal, zonal and global operators on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from potamos.functions import scalars as S
from potamos.operators import cells as C
from potamos.operators import geometry as G
from potamos.operators import rasters as R
from potamos.operators import spatial as P
from potamos.plans.registry import query

_AROUND = "(SELECT unnest([-1, 0, 1]) AS dx) ox CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) oy"


@query("o_r01_fill_river_mask")
def _(t):
    return R.fill_river_mask(t.raster.select("x", "y", "grwl"), cell_km2=0.3, bar_km2=1.0, lake_island_km2=2.0)


@query("o_r01_fill_small_bars")
def _(t):
    return C.fill_small(t.cells.select("x", "y", "water"), "water", 6)


@query("o_r01_clumps")
def _(t):
    return C.clumps(t.cells.select("x", "y", "water"), ["water"]).select("x", "y", "clump")


@query("o_r02_extend_coast")
def _(t):
    return R.extend_coast(t.raster.select("x", "y", "grwl", "land", "coast_dist"), res=30.0, reach=1500.0)


@query(
    "o_r03_patch_lakes",
    "WITH b AS (SELECT minx + 2 AS minx, miny + 2 AS miny, maxx - 2 AS maxx, maxy - 2 AS maxy FROM domains WHERE area > 40) SELECT x, y, CASE WHEN (least(x % 20, 20 - x % 20) <= 1 OR least(y % 20, 20 - y % 20) <= 1) AND EXISTS (SELECT 1 FROM b WHERE x >= minx AND x < maxx AND y >= miny AND y < maxy) THEN 180 ELSE grwl END AS grwl FROM raster",
    ("raster", "domains"),
)
def _(t):
    return R.patch_lake_gaps(t.raster.select("x", "y", "grwl"), t.domains, tile=20, shrink=2.0, gap=1.0, min_area=40.0, size=16.0)


@query("o_r04_patch_tidal_clumps")
def _(t):
    g = C.clumps(t.cells.select("x", "y", (F.col("value") >= 400).alias("f"), (F.col("value") % 5 == 0).alias("tidal")), ["f"])
    return C.spread(g, ["clump"], n=F.count_if("tidal")).where("f AND n > 1").select("x", "y")


@query("o_r05_skeleton")
def _(t):
    return C.thin(t.cells.where("water"))


@query("o_r06_vectorise", "SELECT a.x * 4294967296 + a.y AS start_node, b.x * 4294967296 + b.y AS end_node FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)) WHERE a.value > 900 AND b.value > 900", ("cells",))
def _(t):
    return C.to_lines(t.cells.where("value > 900"))


@query("o_r07_coast_distance", "WITH g AS (SELECT x, y, water AND y < 3 AS s FROM cells) SELECT a.x, a.y, CAST(min(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS INTEGER) AS steps FROM g a CROSS JOIN g b WHERE b.s GROUP BY a.x, a.y HAVING min(greatest(abs(a.x - b.x), abs(a.y - b.y))) <= 10", ("cells",))
def _(t):
    return C.distance_steps(t.cells, F.col("water") & (F.col("y") < 3), limit=10)


@query("o_r08_interbasin_nodes", "SELECT id FROM nodes WHERE elevation > 30 AND darea > 600 AND grwl_value IS NULL", ("nodes",))
def _(t):
    return t.nodes.where("elevation > 30 AND darea > 600 AND grwl_value IS NULL").select("id")


@query(
    "o_r09_condition_elevation",
    "SELECT x, y, round(15 * (coalesce(CASE WHEN grwl = 180 THEN ln(halfwidth / 30) ELSE halfwidth / 30 END, 0) + CASE WHEN centre THEN coalesce(halfwidth / 60 + 5, 0) ELSE 0 END + CASE WHEN halfwidth IS NULL AND osm THEN 2 ELSE 0 END + CASE WHEN halfwidth IS NULL AND osm_small THEN 1 ELSE 0 END + coalesce((500 - end_dist) / 500, 0) * 3), 6) AS lowering FROM raster",
    ("raster",),
)
def _(t):
    return R.dem_lowering(t.raster, 30.0).select("x", "y", F.round("lowering", 6).alias("lowering"))


@query("o_r10_fill_depressions")
def _(t):
    return C.fill_depressions(t.cells)


@query("o_r10_sinks")
def _(t):
    return R.sinks(t.raster.where("elev IS NOT NULL"), cell_km2=100.0, min_fill=1.0, min_km3=0.3)


@query("o_r10_zone_lows", "SELECT zx, zy, quantile_cont(elev, 0.02) AS low, count(CASE WHEN elev < 10 THEN 1 END) AS n_low FROM cells WHERE elev IS NOT NULL GROUP BY zx, zy HAVING sum(value) > 1000", ("cells",))
def _(t):
    z = t.cells.where("elev IS NOT NULL").groupBy("zx", "zy").agg(F.percentile("elev", F.lit(0.02)).alias("low"), F.count_if(F.col("elev") < 10).alias("n_low"), F.sum("value").alias("v"))
    return z.where("v > 1000").select("zx", "zy", "low", "n_low")


_FLOW = "nb AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny, (a.elev - b.elev) / CASE WHEN a.x <> b.x AND a.y <> b.y THEN sqrt(2.0) ELSE 1.0 END AS fall FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.elev > b.elev), fl AS (SELECT x, y, nx, ny FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY fall DESC, nx, ny) AS r FROM nb) q WHERE r = 1)"


@query("o_r11_flow_directions", f"WITH {_FLOW} SELECT c.x, c.y, fl.nx AS to_x, fl.ny AS to_y FROM cells c LEFT JOIN fl ON fl.x = c.x AND fl.y = c.y WHERE c.elev IS NOT NULL", ("cells",))
def _(t):
    return C.steepest(t.cells.where("elev IS NOT NULL"))


@query("o_r11_flow_accumulation", f"WITH {_FLOW}, w AS (SELECT x AS ox, y AS oy, x, y FROM cells WHERE elev IS NOT NULL UNION ALL SELECT w.ox, w.oy, fl.nx, fl.ny FROM w JOIN fl ON fl.x = w.x AND fl.y = w.y) SELECT x, y, count(*) AS n_cells FROM w GROUP BY x, y", ("cells",))
def _(t):
    return C.accumulate(C.steepest(t.cells.where("elev IS NOT NULL")))


@query("o_r13_class_changes")
def _(t):
    """Nodes where the class along a line changes, one of each cluster of 90 m."""
    return R.class_change_nodes(t.vertices.select("id", "pos", "x", "y", F.floor(F.col("value") / 25).alias("class")), 90.0)


@query(
    "o_r14_solver_cells",
    "WITH o AS (SELECT a.x, a.y, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) * 30 AS d FROM raster a CROSS JOIN raster b WHERE a.segment IS NOT NULL AND b.outlet GROUP BY a.x, a.y), m AS (SELECT x, y, v FROM (SELECT a.x, a.y, b.accum AS v, row_number() OVER (PARTITION BY a.x, a.y ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.x, b.y) AS r FROM raster a CROSS JOIN raster b WHERE a.segment IS NOT NULL AND b.accum > 9700) q WHERE r = 1) SELECT a.x, a.y, a.x * 1000 + a.y AS idx, coalesce(elev, 0) AS elevation, coalesce(accum, 1) AS accumulation, d AS outlet_distance, v AS mainchannel_darea FROM raster a LEFT JOIN o ON o.x = a.x AND o.y = a.y LEFT JOIN m ON m.x = a.x AND m.y = a.y WHERE a.segment IS NOT NULL",
    ("raster",),
)
def _(t):
    return R.solver_bands(t.raster, 1000, 30.0, 9700.0)


@query("o_r16_subbasins", f"WITH {_FLOW}, w AS (SELECT x, y, x AS hx, y AS hy, 0 AS steps FROM cells WHERE elev IS NOT NULL UNION ALL SELECT w.x, w.y, fl.nx, fl.ny, steps + 1 FROM w JOIN fl ON fl.x = w.hx AND fl.y = w.hy WHERE NOT (w.hx % 7 = 0 AND w.hy % 5 = 0)) SELECT x, y, arg_max(hx, steps) AS to_x, arg_max(hy, steps) AS to_y, CAST(max(steps) AS BIGINT) AS steps FROM w GROUP BY x, y", ("cells",))
def _(t):
    dry = t.cells.where("elev IS NOT NULL")
    return C.subbasins(C.steepest(dry), dry.where("x % 7 = 0 AND y % 5 = 0"))


@query("o_r17_inflow_sum", f"SELECT c.x, c.y, sum(n.value) AS inflow FROM cells c CROSS JOIN {_AROUND} JOIN cells n ON n.x = c.x + dx AND n.y = c.y + dy AND NOT n.water WHERE NOT (dx = 0 AND dy = 0) GROUP BY c.x, c.y", ("cells",))
def _(t):
    off = t.cells.select("x", "y", F.when(~F.col("water"), F.col("value")).alias("v"))
    return C.focal(off, inflow=F.sum("v")).where("inflow IS NOT NULL").select("x", "y", "inflow")


@query("o_r18_catchments")
def _(t):
    return R.catchments(t.raster, t.reach_table)[0]


@query("o_r18_catchment_table")
def _(t):
    return R.catchments(t.raster, t.reach_table)[1]


@query("o_r18_catchment_reclass", "SELECT x, y, r.segment_id, r.catchment_id FROM raster a JOIN reach_table r ON r.reach_id = a.reach_id", ("raster", "reach_table"))
def _(t):
    return t.raster.select("x", "y", "reach_id").join(t.reach_table, "reach_id").select("x", "y", "segment_id", "catchment_id")


@query("o_r19_height_above_drainage", f"WITH {_FLOW}, w AS (SELECT x, y, x AS hx, y AS hy, 0 AS steps FROM cells WHERE elev IS NOT NULL UNION ALL SELECT w.x, w.y, fl.nx, fl.ny, steps + 1 FROM w JOIN fl ON fl.x = w.hx AND fl.y = w.hy), f AS (SELECT x, y, arg_max(hx, steps) AS hx, arg_max(hy, steps) AS hy FROM w GROUP BY x, y) SELECT f.x, f.y, least(a.elev - b.elev, 100) AS hand FROM f JOIN cells a ON a.x = f.x AND a.y = f.y JOIN cells b ON b.x = f.hx AND b.y = f.hy", ("cells",))
def _(t):
    dry = t.cells.where("elev IS NOT NULL").select("x", "y", "elev")
    to = C.subbasins(C.steepest(dry), dry.limit(0))
    low = dry.select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("elev").alias("low"))
    return to.join(dry, ["x", "y"]).join(low, ["to_x", "to_y"]).select("x", "y", F.least(F.col("elev") - F.col("low"), F.lit(100.0)).alias("hand"))


_BINS = (30, 60, 100, 200, 400, 600, 1000, 2000, 200_000)
_BIN_SQL = "CASE " + " ".join(f"WHEN width <= {b} THEN {b}" for b in _BINS) + " END"


@query("o_r20_transect_bins", f"SELECT id, CAST({_BIN_SQL} AS INTEGER) AS bin, CAST(8 * least({_BIN_SQL}, 10000) AS INTEGER) AS transect FROM lines WHERE width > 0", ("lines",))
def _(t):
    return _binned(t).select("id", "bin", (8 * F.least("bin", F.lit(10_000))).alias("transect"))


def _binned(t):
    width_bin = F.lit(None).cast("int")
    for b in reversed(_BINS):
        width_bin = F.when(F.col("width") <= b, b).otherwise(width_bin)
    return t.lines.where("width > 0").withColumn("bin", width_bin)


@query(
    "o_r20_transects",
    f"WITH b AS (SELECT id, 4 * least({_BIN_SQL}, 10000) AS half FROM lines WHERE width > 0), a AS (SELECT v.id, v.x, v.y, lead(v.x) OVER w AS tx, lead(v.y) OVER w AS ty, v.pos, half FROM wide_vertices v JOIN b ON b.id = v.id WINDOW w AS (PARTITION BY v.id ORDER BY v.pos)), s AS (SELECT *, sqrt(power(tx - x, 2) + power(ty - y, 2)) AS step FROM a WHERE tx IS NOT NULL), u AS (SELECT *, sum(step) OVER (PARTITION BY id ORDER BY pos) AS upto FROM s WHERE step > 0), k AS (SELECT u.*, g.k, (g.k * 100 + 50 - (upto - step)) / step AS share FROM u JOIN (SELECT CAST(unnest(range(0, 200)) AS BIGINT) AS k) g ON g.k >= ceil((upto - step) / 100 - 0.5) AND g.k <= ceil(upto / 100 - 0.5) - 1) SELECT id, k, round(x + share * (tx - x), 4) AS x, round(y + share * (ty - y), 4) AS y, round(x + share * (tx - x) - (ty - y) / step * half, 4) AS ax, round(y + share * (ty - y) + (tx - x) / step * half, 4) AS ay, round(x + share * (tx - x) + (ty - y) / step * half, 4) AS bx, round(y + share * (ty - y) - (tx - x) / step * half, 4) AS by FROM k",
    ("lines", "wide_vertices"),
)
def _(t):
    v = t.wide_vertices.join(_binned(t).select("id", (4 * F.least("bin", F.lit(10_000))).alias("half_width")), "id")
    cut = G.transects(v, 100.0, F.col("half_width"))
    return cut.select("id", F.col("k").cast("long").alias("k"), *(F.round(c, 4).alias(c) for c in ("x", "y", "ax", "ay", "bx", "by")))


_DIST = "sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2))"


@query("o_r21_snap_stations", f"SELECT id, to_id, dist, abs(dev) > 20 OR dist > 500 AS rejected FROM (SELECT s.id, t.id AS to_id, {_DIST} AS dist, (t.darea / s.darea - 1) * 100 AS dev, row_number() OVER (PARTITION BY s.id ORDER BY {_DIST}, t.id) AS r FROM stations s JOIN targets t ON {_DIST} <= 1000 WHERE s.darea > 0) d WHERE r = 1", ("stations", "targets"))
def _(t):
    s = t.stations.where("darea > 0")
    near = P.nearest_within(s.select("id", "x", "y"), t.targets.select("id", "x", "y"), 1000.0)
    joined = near.join(s.select("id", "darea"), "id").join(t.targets.select(F.col("id").alias("to_id"), F.col("darea").alias("to_darea")), "to_id")
    bad = (F.abs(S.percent_deviation(F.col("to_darea"), F.col("darea"))) > 20) | (F.col("dist") > 500)
    return joined.select("id", "to_id", "dist", bad.alias("rejected"))


@query("o_r22_combined_accumulation", "WITH n AS (SELECT v.x / 30 AS x, v.y / 30 AS y, max(l.length) AS darea FROM vertices v JOIN lines l ON l.id = v.id GROUP BY 1, 2) SELECT c.x, c.y, coalesce(n.darea, least(c.value, 500)) AS accum FROM cells c LEFT JOIN n ON n.x = c.x AND n.y = c.y", ("cells", "vertices", "lines"))
def _(t):
    """The network's drainage area on its cells, the capped one elsewhere."""
    on = t.vertices.join(t.lines.select("id", "length"), "id").groupBy((F.col("x") / 30).cast("long").alias("x"), (F.col("y") / 30).cast("long").alias("y")).agg(F.max("length").alias("net"))
    return t.cells.join(on, ["x", "y"], "left").select("x", "y", F.coalesce("net", F.least("value", F.lit(500.0))).alias("accum"))


@query("o_r24_output_tiles", "SELECT DISTINCT x // 20 * 20 AS west, y // 20 * 20 AS south FROM cells WHERE value > 500", ("cells",))
def _(t):
    return t.cells.where("value > 500").select((F.floor(F.col("x") / 20) * 20).alias("west"), (F.floor(F.col("y") / 20) * 20).alias("south")).distinct()


@query("o_r25_stream_density", "WITH c AS (SELECT zx, zy, class, count(*) AS k, count(CASE WHEN water THEN 1 END) AS s FROM cells GROUP BY zx, zy, class) SELECT zx, zy, sum(s) / sum(k) AS density, arg_min(class, r) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY zx, zy ORDER BY k DESC, class) AS r FROM c) q GROUP BY zx, zy", ("cells",))
def _(t):
    return R.density_class(t.cells, ["zx", "zy"], F.col("water"), "class")


@query("o_r27_bank_distance", "SELECT a.x, a.y, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) * 30 AS bank FROM cells a CROSS JOIN cells b WHERE a.water AND NOT b.water GROUP BY a.x, a.y", ("cells",))
def _(t):
    return R.bank_distance(t.cells, 30.0)


_CLASSED = "(VALUES (0.0, 200.0), (200.0, 500.0), (500.0, 2000.0), (2000.0, 100000.0))"


@query(
    "o_r21_snap_in_class",
    f"WITH k AS (SELECT col0 AS lb, col1 AS ub FROM {_CLASSED} v), n AS (SELECT s.id, t.id AS to_id, {_DIST} AS dist, (t.darea / s.darea - 1) * 100 AS dev, row_number() OVER (PARTITION BY s.id ORDER BY {_DIST}, t.id) AS r FROM stations s JOIN k ON s.darea > lb AND s.darea <= ub JOIN targets t ON t.darea > 0.8 * lb AND t.darea <= 1.2 * ub AND {_DIST} <= 2000) SELECT id, to_id, dist, abs(dev) <= 20 AS is_valid FROM n WHERE r = 1",
    ("stations", "targets"),
)
def _(t):
    """Snapping to centre line points of a like drainage area, with the deviation that makes a station valid."""
    s = t.stations.select("id", "x", "y", "darea")
    near = P.class_binned_nearest(s, t.targets.select("id", "x", "y", "darea"), [0.0, 200.0, 500.0, 2000.0, 100_000.0], 2000.0)
    return near.select("id", "to_id", "dist", (F.abs(S.percent_deviation(F.col("to_darea"), F.col("darea"))) <= 20).alias("is_valid"))


@query("o_r21_snap_to_cells", "SELECT id, cx, cy, dist FROM (SELECT s.id, c.x AS cx, c.y AS cy, sqrt(power(s.x / 100 - c.x, 2) + power(s.y / 100 - c.y, 2)) AS dist, row_number() OVER (PARTITION BY s.id ORDER BY sqrt(power(s.x / 100 - c.x, 2) + power(s.y / 100 - c.y, 2)), c.x, c.y) AS r FROM stations s JOIN cells c ON c.value > 800 AND sqrt(power(s.x / 100 - c.x, 2) + power(s.y / 100 - c.y, 2)) <= 6) q WHERE r = 1", ("stations", "cells"))
def _(t):
    """Snapping to the nearest cell of enough accumulation."""
    big = t.cells.where("value > 800").select(C.cell_id().alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = P.nearest_within(t.stations.select("id", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y")), big, 6.0)
    return near.select("id", F.shiftright("to_id", 32).alias("cx"), F.col("to_id").bitwiseAND(0xFFFFFFFF).alias("cy"), "dist")


@query("o_r21_snap_by_reach", "SELECT s.id, r.id AS reach, r.seq FROM stations s JOIN LATERAL (SELECT p.id, p.seq FROM reach_pieces p WHERE p.id = s.id + 64 ORDER BY sqrt(power(p.x - s.x, 2) + power(p.y - s.y, 2)), p.seq LIMIT 1) r ON true", ("stations", "reach_pieces"))
def _(t):
    """Stations whose reach is known go to its nearest part."""
    s = t.stations.select("id", (F.col("id") + 64).alias("reach"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    at = t.reach_pieces.select(F.col("id").alias("reach"), "seq", "x", "y").join(s, "reach").withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)))
    return at.groupBy("id", "reach").agg(F.min(F.struct("dist", "seq")).alias("b")).select("id", "reach", "b.seq")


@query("o_r21_stations_off_network", f"SELECT s.id FROM stations s WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE {_DIST} <= 500)", ("stations", "targets"))
def _(t):
    """Stations that no centre line point is near: what snapping leaves out."""
    near = P.nearest_within(t.stations.select("id", "x", "y"), t.targets.select("id", "x", "y"), 500.0)
    return t.stations.select("id").join(near, "id", "left_anti")
