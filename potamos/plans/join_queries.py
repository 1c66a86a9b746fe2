"""Queries over joins: key joins, semi and anti joins, cell lookups, nearest, range and box joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from potamos.functions import scalars as S
from potamos.operators import cells as C
from potamos.operators import domains as D
from potamos.operators import geometry as G
from potamos.operators import network as N
from potamos.operators import spatial as P
from potamos.plans.registry import query

_DIST = "sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2))"


@query("o_j01_left_attributes", "SELECT l.id, n.darea, n.grwl_value FROM lines l LEFT JOIN nodes n ON n.id = l.start_node", ("lines", "nodes"))
def _(t):
    return N.with_attributes(t.lines.select("id", F.col("start_node")), t.nodes.select(F.col("id").alias("start_node"), "darea", "grwl_value"), "start_node").select("id", "darea", "grwl_value")


@query("o_j02_overlay_adds_keys", "SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.darea) AS darea FROM nodes a FULL JOIN (SELECT id, abs(darea) * 3 AS v FROM stations) b ON a.id = b.id", ("nodes", "stations"))
def _(t):
    return N.overlay(t.nodes.select("id", "darea"), t.stations.select("id", (F.abs("darea") * 3).alias("darea")), "id", ["darea"])


@query("o_j03_column_subset_join", "SELECT l.id, s.darea FROM lines l LEFT JOIN stations s ON s.id = l.id", ("lines", "stations"))
def _(t):
    return N.with_attributes(t.lines.select("id"), t.stations, "id", ["darea"])


@query("o_j04_other_end", "SELECT n.id AS node, l.id AS line, l.end_node AS other FROM nodes n JOIN lines l ON l.start_node = n.id WHERE n.is_lake = 1 UNION ALL SELECT n.id, l.id, l.start_node FROM nodes n JOIN lines l ON l.end_node = n.id WHERE n.is_lake = 1", ("lines", "nodes"))
def _(t):
    return N.other_end(t.nodes.where("is_lake = 1"), t.lines)


@query("o_j05_semi", "SELECT id FROM lines WHERE end_node IN (SELECT id FROM nodes WHERE is_lake = 1)", ("lines", "nodes"))
def _(t):
    return t.lines.join(t.nodes.where("is_lake = 1").select(F.col("id").alias("end_node")), "end_node", "left_semi").select("id")


@query("o_j06_anti", "SELECT id FROM nodes WHERE id NOT IN (SELECT start_node FROM loose_lines) AND id NOT IN (SELECT end_node FROM loose_lines)", ("loose_lines", "nodes"))
def _(t):
    return t.nodes.join(N.incidence(t.loose_lines).select(F.col("node").alias("id")), "id", "left_anti").select("id")


@query("o_j07_parallel_lines", "SELECT id, n_parallel FROM (SELECT id, start_node, end_node, count(*) OVER (PARTITION BY least(start_node, end_node), greatest(start_node, end_node)) AS n_parallel FROM messy_lines) w WHERE n_parallel > 1 AND start_node <> end_node", ("messy_lines",))
def _(t):
    return N.parallel_lines(t.messy_lines).select("id", "n_parallel")


@query("o_j08_cell_sample", "SELECT s.id, c.elev, c.value FROM stations s LEFT JOIN cells c ON c.x = CAST(floor(s.x / 100) AS BIGINT) AND c.y = CAST(floor(s.y / 100) AS BIGINT)", ("stations", "cells"))
def _(t):
    return C.sample(t.stations, t.cells, ["elev", "value"], res=100.0).select("id", "elev", "value")


@query("o_j09_vertex_values", "SELECT v.id, array_to_string(list(CAST(CAST(coalesce(c.value, -9999) AS BIGINT) AS VARCHAR) ORDER BY v.pos), ',') AS path FROM vertices v LEFT JOIN cells c ON c.x = v.pos AND c.y = v.id % 150 GROUP BY v.id", ("vertices", "cells"))
def _(t):
    at = t.vertices.select("id", "pos", F.col("pos").cast("long").alias("x"), (F.col("id") % 150).alias("y"))
    got = at.join(t.cells.select("x", "y", "value"), ["x", "y"], "left").select("id", F.struct("pos", F.coalesce("value", F.lit(-9999.0)).cast("long").alias("v")).alias("s"))
    return got.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("s")).select("id", F.array_join(F.transform("s", lambda s: s.v.cast("string")), ",").alias("path"))


@query("o_j10_nearest", f"SELECT id, to_id, dist FROM (SELECT s.id, t.id AS to_id, {_DIST} AS dist, row_number() OVER (PARTITION BY s.id ORDER BY {_DIST}, t.id) AS r FROM stations s CROSS JOIN targets t) d WHERE r = 1", ("stations", "targets"))
def _(t):
    return P.nearest(t.stations.select("id", "x", "y"), t.targets.select("id", "x", "y"), start=500.0)


@query("o_j11_bounded_nearest", f"SELECT id, to_id, dist FROM (SELECT s.id, t.id AS to_id, {_DIST} AS dist, row_number() OVER (PARTITION BY s.id ORDER BY {_DIST}, t.id) AS r FROM stations s JOIN targets t ON {_DIST} BETWEEN 60 AND 700) d WHERE r = 1", ("stations", "targets"))
def _(t):
    return P.nearest_within(t.stations.select("id", "x", "y"), t.targets.select("id", "x", "y"), 700.0, 60.0)


@query("o_j12_exact_coincidence", "SELECT a.id, min(b.id) AS twin FROM vertices a JOIN vertices b ON a.x = b.x AND a.y = b.y AND b.id < a.id GROUP BY a.id", ("vertices",))
def _(t):
    first = t.vertices.groupBy("x", "y").agg(F.min("id").alias("twin"))
    return t.vertices.join(first, ["x", "y"]).where("twin < id").groupBy("id").agg(F.min("twin").alias("twin"))


_BOUNDS = [0.0, 10, 50, 100, 500, 1000, 2000, 4000, 6000, 8000, 10000]
_CLASSES = ", ".join(f"({a}, {b})" for a, b in zip(_BOUNDS, _BOUNDS[1:]))


@query(
    "o_j13_class_binned_nearest",
    f"WITH bounds AS (SELECT col0 AS lb, col1 AS ub FROM (VALUES {_CLASSES}) v) SELECT id, to_id, dist FROM (SELECT s.id, t.id AS to_id, {_DIST} AS dist, row_number() OVER (PARTITION BY s.id ORDER BY {_DIST}, t.id) AS r FROM stations s JOIN bounds b ON s.darea > lb AND s.darea <= ub JOIN targets t ON t.darea > 0.8 * lb AND t.darea <= 1.2 * ub AND {_DIST} <= 2000) d WHERE r = 1",
    ("stations", "targets"),
)
def _(t):
    return P.class_binned_nearest(t.stations.select("id", "x", "y", "darea"), t.targets.select("id", "x", "y", "darea"), _BOUNDS, 2000.0).select("id", "to_id", "dist")


@query("o_j14_points_in_boxes", "SELECT s.id, d.id AS box_id FROM (SELECT id, x / 100 AS x, y / 100 AS y FROM stations) s JOIN domains d ON s.x >= minx AND s.x < maxx AND s.y >= miny AND s.y < maxy", ("stations", "domains"))
def _(t):
    return P.boxes_holding(t.stations.select("id", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y")), t.domains, 10.0)


@query("o_j14_points_in_polygons", "SELECT s.id, d.id AS polygon_id FROM (SELECT id, x / 100 AS x, y / 100 AS y FROM stations) s JOIN diamonds d ON abs(s.x - cx) / (maxx - cx) + abs(s.y - cy) / (maxy - cy) < 1", ("stations", "diamonds"))
def _(t):
    # in hundredths, so that all are whole numbers and a point on an edge is seen as such
    corner = lambda x, y: F.struct((F.col(x) * 100).cast("double").alias("x"), (F.col(y) * 100).cast("double").alias("y"))
    rings = t.diamonds.select("id", F.array(corner("cx", "miny"), corner("maxx", "cy"), corner("cx", "maxy"), corner("minx", "cy")).alias("ring"))
    return G.points_in_polygons(t.stations.select("id", "x", "y"), rings, 1000.0)


@query(
    "o_r23_riverbank_widths",
    "SELECT s.id, w.median_width, w.n_transects FROM (SELECT id, id + 64 AS reach_id, x / 100 AS x, y / 100 AS y FROM stations) s JOIN (SELECT id, quantile_cont(value, 0.5) AS median_width, count(value) AS n_transects FROM vertices WHERE pos > 1 AND value > 20 GROUP BY id HAVING count(value) >= 2) w ON w.id = s.reach_id WHERE EXISTS (SELECT 1 FROM domains WHERE s.x >= minx AND s.x < maxx AND s.y >= miny AND s.y < maxy)",
    ("stations", "domains", "vertices"),
)
def _(t):
    at = t.stations.select("id", (F.col("id") + 64).alias("reach_id"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))
    transects = t.vertices.where("pos > 1 AND value > 20").select(F.col("id").alias("reach_id"), F.col("value").alias("width"))
    return P.riverbank_widths(at, t.domains, transects, 10.0)


_OVER = "a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy"


@query("o_j15_box_join", f"SELECT a.id AS a_id, b.id AS b_id FROM domains a JOIN (SELECT id, minx + 5 AS minx, maxx + 5 AS maxx, miny + 3 AS miny, maxy + 3 AS maxy FROM domains) b ON {_OVER}", ("domains",))
def _(t):
    d = t.domains
    moved = d.select("id", (F.col("minx") + 5).alias("minx"), (F.col("maxx") + 5).alias("maxx"), (F.col("miny") + 3).alias("miny"), (F.col("maxy") + 3).alias("maxy"))
    return P.overlapping_boxes(d, moved, 10.0)


@query(
    "o_j16_best_area_match",
    f"SELECT s.id, d.to_id, d.pdiff FROM stations s LEFT JOIN (SELECT s.id, t.id AS to_id, abs(t.darea / s.darea - 1) * 100 AS pdiff, row_number() OVER (PARTITION BY s.id ORDER BY abs(t.darea / s.darea - 1) * 100, {_DIST}, t.id) AS r FROM stations s JOIN targets t ON {_DIST} <= 800) d ON d.id = s.id AND d.r = 1 WHERE s.darea > 0",
    ("stations", "targets"),
)
def _(t):
    return P.best_match(t.stations.where("darea > 0"), t.targets, 800.0).select("id", "to_id", "pdiff")


@query("o_j17_point_overlay", "SELECT DISTINCT a.id FROM vertices a JOIN vertices b ON a.x = b.x AND a.y = b.y WHERE a.id % 2 = 0 AND b.id % 2 = 1", ("vertices",))
def _(t):
    a, b = t.vertices.where("id % 2 = 0"), t.vertices.where("id % 2 = 1")
    return a.join(b.select("x", "y"), ["x", "y"], "left_semi").select("id").distinct()


@query("o_j18_envelope_self_join", f"SELECT a.id AS a_id, b.id AS b_id, a.minx <= b.minx AND a.maxx >= b.maxx AND a.miny <= b.miny AND a.maxy >= b.maxy AS holds FROM domains a JOIN domains b ON a.id <> b.id AND {_OVER}", ("domains",))
def _(t):
    d = t.domains
    pairs = P.overlapping_boxes(d, d, 10.0).where("a_id <> b_id")
    a, b = d.alias("a"), d.alias("b")
    return pairs.join(a, F.col("a.id") == F.col("a_id")).join(b, F.col("b.id") == F.col("b_id")).select("a_id", "b_id", S.box_contains("a", "b").alias("holds"))


@query("o_j19_region_neighbours", "SELECT a.id AS a_id, b.id AS b_id FROM domains a JOIN domains b ON a.region = b.region AND a.id < b.id AND a.minx - 40 <= b.maxx AND b.minx <= a.maxx + 40 AND a.miny - 40 <= b.maxy AND b.miny <= a.maxy + 40", ("domains",))
def _(t):
    a, b = t.domains.alias("a"), t.domains.alias("b")
    near = (F.col("a.minx") - 40 <= F.col("b.maxx")) & (F.col("b.minx") <= F.col("a.maxx") + 40) & (F.col("a.miny") - 40 <= F.col("b.maxy")) & (F.col("b.miny") <= F.col("a.maxy") + 40)
    return a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.id") < F.col("b.id")) & near).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(
    "o_j20_sides_by_cells",
    "WITH v AS (SELECT id, pos, CAST(x / 30 AS BIGINT) AS x, CAST(y / 30 AS BIGINT) AS y FROM vertices), a AS (SELECT id, x, y, sign(lead(x) OVER w - x) AS dx, sign(lead(y) OVER w - y) AS dy FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)), s AS (SELECT id, x - dy AS lx, y + dx AS ly, x + dy AS rx, y - dx AS ry FROM a WHERE dx IS NOT NULL) SELECT id, max(l.value) AS left_value, max(r.value) AS right_value FROM s LEFT JOIN cells l ON l.x = lx AND l.y = ly LEFT JOIN cells r ON r.x = rx AND r.y = ry GROUP BY id",
    ("vertices", "cells"),
)
def _(t):
    """The greatest value on either side of directed lines, from the cells beside each step."""
    v = t.vertices.select("id", "pos", (F.col("x") / 30).cast("long").alias("x"), (F.col("y") / 30).cast("long").alias("y"))
    w = Window.partitionBy("id").orderBy("pos")
    a = v.withColumns({"dx": F.signum(F.lead("x").over(w) - F.col("x")).cast("long"), "dy": F.signum(F.lead("y").over(w) - F.col("y")).cast("long")}).where("dx IS NOT NULL")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), (F.col("x") - F.col("dy")).alias("x"), (F.col("y") + F.col("dx")).alias("y")), F.struct(F.lit("r").alias("side"), (F.col("x") + F.col("dy")).alias("x"), (F.col("y") - F.col("dx")).alias("y")))).alias("s")
    at = a.select("id", sides).select("id", "s.side", "s.x", "s.y").join(t.cells.select("x", "y", "value"), ["x", "y"], "left")
    return at.groupBy("id").agg(F.max(F.when(F.col("side") == "l", F.col("value"))).alias("left_value"), F.max(F.when(F.col("side") == "r", F.col("value"))).alias("right_value"))


@query("o_j21_fix_line_match", "SELECT line, CASE WHEN d < 10 THEN start_node WHEN d > 170 THEN end_node END AS upstream_node FROM (SELECT *, abs(((fix_azimuth - azimuth + 180) % 360 + 360) % 360 - 180) AS d FROM fix_matches WHERE share > 0.9) x", ("fix_matches",))
def _(t):
    return N.fix_links(t.fix_matches)


@query("o_j22_id_translation", "SELECT l.id, v.value FROM lines l JOIN (SELECT id + 10000000 * 3 AS global_id, sum(value) AS value FROM vertices GROUP BY id) v ON v.global_id - 30000000 = l.id", ("lines", "vertices"))
def _(t):
    stats = t.vertices.groupBy((F.col("id") + 3 * 10_000_000).alias("global_id")).agg(F.sum("value").alias("value"))
    keys = t.lines.select("id", (F.col("id") + 3 * 10_000_000).alias("global_id"))
    return keys.join(stats, "global_id").select("id", "value")


@query("o_j23_lookup_chain", "SELECT v.id AS reach, v.pos, l.start_node AS segment, n.grwl_value AS catchment FROM vertices v JOIN lines l ON l.id = v.id JOIN nodes n ON n.id = l.start_node WHERE n.grwl_value IS NOT NULL", ("vertices", "lines", "nodes"))
def _(t):
    chain = t.vertices.select("id", "pos").join(t.lines.select("id", "start_node"), "id").join(t.nodes.select(F.col("id").alias("start_node"), "grwl_value"), "start_node")
    return chain.dropna(subset=["grwl_value"]).select(F.col("id").alias("reach"), "pos", F.col("start_node").alias("segment"), F.col("grwl_value").alias("catchment"))


@query("o_j24_region_lookup", "SELECT s.id, r.r_name AS region FROM stations s LEFT JOIN nation n ON n.n_nationkey = s.nation LEFT JOIN region r ON r.r_regionkey = n.n_regionkey", ("stations",))
def _(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    return t.stations.select("id", "nation").join(names, "nation", "left").select("id", "region")


@query("o_j25_transect_width", "SELECT l.id, count(v.pos) AS n, coalesce(max(v.x) - min(v.x), 0) AS width FROM lines l LEFT JOIN (SELECT * FROM vertices WHERE value > 30) v ON v.id = l.id GROUP BY l.id", ("lines", "vertices"))
def _(t):
    hit = t.vertices.where("value > 30").groupBy("id").agg(F.count("pos").alias("n"), (F.max("x") - F.min("x")).alias("width"))
    return N.with_attributes(t.lines.select("id"), hit, "id").fillna(0, ["n", "width"])


@query(
    "o_j25_transects_on_banks",
    "WITH c AS (SELECT id, pos, x, y, CAST(floor(x / 100) AS BIGINT) AS gx, CAST(floor(y / 100) AS BIGINT) AS gy FROM reach_points), h AS (SELECT c.id, c.pos FROM c JOIN cells k ON k.x = gx AND k.y = gy AND k.water) SELECT id AS reach_id, count(*) AS n_wet, max(pos) - min(pos) + 1 AS span FROM h GROUP BY id".replace("reach_points", "(SELECT id, seq AS pos, x, y FROM reach_pieces) q"),
    ("reach_pieces", "cells"),
)
def _(t):
    """Places of a reach that lie on water cells, which stand for riverbanks, and how far apart they reach."""
    at = C.sample(t.reach_pieces.select("id", "seq", "x", "y"), t.cells, ["water"], res=100.0).where("water")
    return at.groupBy(F.col("id").alias("reach_id")).agg(F.count("*").alias("n_wet"), (F.max("seq") - F.min("seq") + 1).alias("span"))


@query("o_j26_pairs_in_band", "SELECT a.start_node AS root, a.id AS a_id, b.id AS b_id FROM lines a JOIN lines b ON a.end_node = b.end_node AND a.id < b.id AND abs(a.length - b.length) <= 50", ("lines",))
def _(t):
    a, b = t.lines.alias("a"), t.lines.alias("b")
    pairs = a.join(b, (F.col("a.end_node") == F.col("b.end_node")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.length") - F.col("b.length")) <= 50))
    return pairs.select(F.col("a.start_node").alias("root"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("o_j27_from_to_pairs", "SELECT a.id AS from_node, b.id AS to_node FROM nodes a CROSS JOIN nodes b WHERE a.id < 40 AND b.id >= 40 AND b.id < 64", ("nodes",))
def _(t):
    return t.nodes.where("id < 40").select(F.col("id").alias("from_node")).crossJoin(F.broadcast(t.nodes.where("id >= 40 AND id < 64").select(F.col("id").alias("to_node"))))  # both sides are stated sets of ids


@query("o_u03_patch_layers", "SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.elev, b.value) AS v FROM (SELECT * FROM cells WHERE x < 60) a FULL JOIN (SELECT * FROM cells WHERE x > 30) b ON a.x = b.x AND a.y = b.y", ("cells",))
def _(t):
    return C.patch(t.cells.where("x < 60").withColumn("v", F.col("elev")), t.cells.where("x > 30").withColumn("v", F.col("value")), band="v")


@query("o_g30_allocate_components")
def _(t):
    return D.allocate_components(t.shared_nodes)


@query("o_g31_agglomerate_domains")
def _(t):
    return D.agglomerate(t.basins, 900.0)


@query("o_g31_agglomerate_by_product")
def _(t):
    return D.agglomerate(t.basins, 900.0, ("compactness", "area_deficit", "non_overlapping_ratio"), buffer=5.0)


@query("o_g32_grow_within_distance")
def _(t):
    return D.grow_domains(t.basins, 900.0, "within_distance", max_distance=20.0)


@query("o_g32_grow_largest")
def _(t):
    return D.grow_domains(t.basins, 900.0, "largest", max_distance=40.0, min_compactness=0.05)


@query("o_g32_grow_most_compact")
def _(t):
    return D.grow_domains(t.basins, 900.0, "most_compact")


@query("o_g33_drop_contained", "SELECT id FROM (SELECT id, minx, miny, CASE WHEN id % 6 = 0 THEN maxx + 40 ELSE maxx END AS maxx, CASE WHEN id % 6 = 0 THEN maxy + 40 ELSE maxy END AS maxy FROM domains) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT id, minx, miny, CASE WHEN id % 6 = 0 THEN maxx + 40 ELSE maxx END AS maxx, CASE WHEN id % 6 = 0 THEN maxy + 40 ELSE maxy END AS maxy FROM domains) a WHERE a.id <> b.id AND a.minx <= b.minx AND a.maxx >= b.maxx AND a.miny <= b.miny AND a.maxy >= b.maxy)", ("domains",))
def _(t):
    grown = t.domains.select("id", "minx", "miny", F.when(F.col("id") % 6 == 0, F.col("maxx") + 40).otherwise(F.col("maxx")).alias("maxx"), F.when(F.col("id") % 6 == 0, F.col("maxy") + 40).otherwise(F.col("maxy")).alias("maxy"))
    pairs = P.overlapping_boxes(grown, grown, 20.0).where("a_id <> b_id")
    held = pairs.join(grown.alias("a"), F.col("a.id") == F.col("a_id")).join(grown.alias("b"), F.col("b.id") == F.col("b_id")).where(S.box_contains("a", "b")).select(F.col("b_id").alias("id"))
    return grown.join(held, "id", "left_anti").select("id")
