"""Queries over scans, sinks, filters, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from potamos.functions import scalars as S
from potamos.operators import cells as C
from potamos.operators import geometry as G
from potamos.operators import network as N
from potamos.plans.registry import query
from potamos.sources import io


@query("o_s01_attribute_scan", "SELECT id, darea, is_lake FROM nodes", ("nodes",))
def _(t):
    return io.attribute_table(t.nodes, "id", ["darea", "is_lake"])


@query("o_s02_overlay_write", "SELECT id, CASE WHEN id % 3 = 0 THEN darea * 2 ELSE darea END AS darea, is_lake FROM nodes", ("nodes",))
def _(t):
    path = io.scratch(t.spark)
    changed = t.nodes.where("id % 3 = 0").select("id", (F.col("darea") * 2).alias("darea"))
    N.overlay(t.nodes.select("id", "darea", "is_lake"), changed, "id", ["darea"]).write.parquet(path)
    return t.spark.read.parquet(path)


@query("o_s03_vertex_text", "SELECT id, pos, x, y FROM vertices", ("vertices",))
def _(t):
    path = io.scratch(t.spark)
    io.write_vertices(t.vertices, path)
    return io.read_vertices(t.spark, path)


@query("o_s04_cell_text", "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, elev FROM cells", ("cells",))
def _(t):
    path = io.scratch(t.spark)
    io.write_xyz(t.cells, path, "elev")
    return io.read_xyz(t.spark, path, ["elev"])


@query("o_s05_network_nodes", "SELECT n.id, array_to_string(list_sort(list(e.line)), ',') AS line_cats, CAST(count(*) AS BIGINT) AS n_lines, any_value(n.darea) AS darea FROM (SELECT id AS line, start_node AS node FROM lines UNION SELECT id, end_node FROM lines) e JOIN nodes n ON n.id = e.node GROUP BY n.id", ("lines", "nodes"))
def _(t):
    found = N.with_attributes(N.node_table(t.lines), t.nodes, "id", ["darea"])
    return found.select("id", F.concat_ws(",", F.transform("line_cats", lambda i: i.cast("string"))).alias("line_cats"), "n_lines", "darea")


@query("o_s06_network_lines", "SELECT l.id, l.start_node, l.end_node, n.darea FROM lines l LEFT JOIN nodes n ON n.id = l.end_node", ("lines", "nodes"))
def _(t):
    return N.with_attributes(t.lines.select("id", "start_node", "end_node"), t.nodes.select(F.col("id").alias("end_node"), "darea"), "end_node").select("id", "start_node", "end_node", "darea")


@query("o_s07_edge_projection", "SELECT start_node, end_node, id, length FROM lines", ("lines",))
def _(t):
    return t.lines.select("start_node", "end_node", "id", "length")


@query("o_s08_explode_points", "SELECT id, pos, x, y FROM vertices", ("vertices",))
def _(t):
    multi = t.vertices.groupBy("id").agg(F.collect_list(F.struct("pos", "x", "y")).alias("points"))
    return multi.select("id", F.explode("points").alias("p")).select("id", "p.pos", "p.x", "p.y")


@query("o_s09_parse_points", "SELECT id, CASE WHEN id % 2 = 0 THEN x ELSE x + 1 END AS x, CASE WHEN id % 2 = 0 THEN y ELSE y + 2 END AS y FROM stations", ("stations",))
def _(t):
    point = lambda dx, dy: F.concat_ws(" ", F.col("x") + dx, F.col("y") + dy)
    wkt = F.when(F.col("id") % 2 == 0, F.concat(F.lit("POINT ("), point(0, 0), F.lit(")"))).otherwise(F.concat(F.lit("MULTIPOINT ("), point(0, 0), F.lit(", "), point(2, 4), F.lit(")")))
    return t.stations.select("id", io.parse_point(wkt).alias("p")).select("id", "p.x", "p.y")


@query("o_s10_merge_layers", "SELECT id, darea, CAST(NULL AS DOUBLE) AS length, 'nodes' AS layer FROM nodes WHERE darea > 500 UNION ALL SELECT id, NULL, length, 'lines' FROM lines", ("nodes", "lines"))
def _(t):
    return io.merge_layers({"nodes": t.nodes.where("darea > 500").select("id", "darea"), "lines": t.lines.select("id", "length"), "vertices": t.vertices.select("x")}, "layer", "id").select("id", "darea", "length", "layer")


@query(
    "o_s11_read_domains",
    "WITH d AS (SELECT concat('D', lpad(CAST(region AS VARCHAR), 3, '0')) AS id, region AS cat, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, sum(area) AS area FROM domains WHERE id % 4 <> 1 GROUP BY region) SELECT a.id, a.cat, a.minx, a.miny, a.maxx, a.maxy, a.area, coalesce(string_agg(b.id, ',' ORDER BY b.id), '') AS ids_in_envelope FROM d a LEFT JOIN d b ON b.id <> a.id AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy GROUP BY ALL",
    ("domains",),
)
def _(t):
    """Polygons chosen by a table, those of one key as one, with new ids and the ids of overlapping envelopes."""
    chosen = t.domains.where("id % 4 <> 1").select("id")
    ids = t.domains.select(F.col("region").alias("cat"), F.format_string("D%03d", "region").alias("new_id")).distinct()
    polygons = t.domains.join(chosen, "id", "left_semi").withColumnRenamed("region", "cat")
    return io.read_domains(polygons, ids, 10.0)


@query("o_s12_read_nodes", "SELECT CAST(grwl_value AS BIGINT) AS comp, id FROM nodes WHERE grwl_value IS NOT NULL", ("nodes",))
def _(t):
    return t.nodes.select("grwl_value", "id").dropna().select(F.col("grwl_value").cast("long").alias("comp"), "id")


@query("o_s13_cached_segments", "SELECT id, count(*) AS n, sum(value) AS value FROM vertices GROUP BY id", ("vertices",))
def _(t):
    """Read if it is there, else built; the second call reads what the first has written."""
    path = io.scratch(t.spark)
    io.cached(t.spark, path, lambda: t.vertices)
    held = io.cached(t.spark, path, lambda: t.vertices.limit(0))
    return held.groupBy("id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("o_s14_id_sink", "SELECT id FROM lines WHERE length < 1000", ("lines",))
def _(t):
    path = io.scratch(t.spark)
    io.write_ids(t.lines.where("length < 1000"), "id", path)
    return io.read_ids(t.spark, path, "id")


@query("o_s15_cell_sink_min", "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, min(value) AS value FROM vertices GROUP BY x, y", ("vertices",))
def _(t):
    path = io.scratch(t.spark)
    io.write_xyz(t.vertices, path, "value")
    return io.read_xyz(t.spark, path, ["value"])


@query("o_s16_partitioned_export", "SELECT id, darea, nation FROM stations WHERE nation < 5", ("stations",))
def _(t):
    path = io.scratch(t.spark)
    io.export(t.stations.select("id", "darea", "nation"), path, "nation")
    return t.spark.read.parquet(path).where("nation < 5")


@query("o_s17_input_filters", "SELECT id, waterway, CASE WHEN waterway IN ('river', 'canal') THEN 'line' ELSE 'other' END AS kind FROM tags WHERE waterway IS NOT NULL AND name NOT LIKE '%Pond%'", ("tags",))
def _(t):
    return t.tags.where("waterway IS NOT NULL AND name NOT LIKE '%Pond%'").select("id", "waterway", F.when(F.col("waterway").isin("river", "canal"), "line").otherwise("other").alias("kind"))


@query("o_s17_lake_connector", "SELECT id, name FROM domains WHERE area > 50 AND name NOT IN ('CHINA', 'BRAZIL', 'nation_3') AND minx >= 10", ("domains",))
def _(t):
    """Lakes by size and place without those of an exclusion list."""
    return io.excluding(t.domains.where("area > 50 AND minx >= 10"), "name", ["CHINA", "BRAZIL", "nation_3"]).select("id", "name")


@query("o_s17_land_mask", "SELECT x, y FROM raster WHERE land AND coast_dist >= 300", ("raster",))
def _(t):
    return t.raster.where("land AND coast_dist >= 300").select("x", "y")


@query("o_s17_class_mosaic", "SELECT x, y, CASE WHEN grwl IN (180, 255, 126) THEN grwl WHEN value > 500 THEN 86 END AS grwl FROM raster WHERE grwl IS NOT NULL OR value > 500", ("raster",))
def _(t):
    """Water classes patched with a second source where the first has none."""
    first = t.raster.where(F.col("grwl").isin(180, 255, 126)).select("x", "y", F.col("grwl").alias("grwl"))
    second = t.raster.where("value > 500").select("x", "y", F.lit(86).alias("grwl"))
    return C.patch(first, second, band="grwl")


@query("o_s17_domain_region", "SELECT id, floor((minx - 3) / 2) * 2 AS west, floor((miny - 3) / 2) * 2 AS south, ceil((maxx + 3) / 2) * 2 AS east, ceil((maxy + 3) / 2) * 2 AS north FROM domains", ("domains",))
def _(t):
    """A domain's region: its box, grown and aligned to the grid."""
    return io.aligned_boxes(t.domains, 3.0, 2.0).select("id", "west", "south", "east", "north")


@query("o_s18_predictors", "SELECT x, y, coalesce(elev, 0) AS volume, value * 0.5 AS scaled, value * 86400 * 365 / 1000 AS runoff_mm, value * 0.0001 AS aridity, CASE WHEN value = 9999 THEN NULL ELSE value END AS masked FROM cells", ("cells",))
def _(t):
    v = F.col("value")
    return t.cells.select("x", "y", F.coalesce("elev", F.lit(0.0)).alias("volume"), (v * 0.5).alias("scaled"), (v * 86400 * 365 / 1000).alias("runoff_mm"), (v * 0.0001).alias("aridity"), F.nullif(v, F.lit(9999.0)).alias("masked"))


@query("o_s18_reservoirs", "SELECT c.x, c.y, coalesce(sum(s.darea), 0) AS volume FROM cells c LEFT JOIN stations s ON floor(s.x / 100) = c.x AND floor(s.y / 100) = c.y GROUP BY c.x, c.y", ("cells", "stations"))
def _(t):
    """Points summed into cells, 0 where there is none."""
    held = t.stations.groupBy(F.floor(F.col("x") / 100).alias("x"), F.floor(F.col("y") / 100).alias("y")).agg(F.sum("darea").alias("volume"))
    return t.cells.select("x", "y").join(held, ["x", "y"], "left").fillna(0.0, ["volume"])


@query("o_s19_upstream_area", "SELECT id, coalesce(nullif(darea, 50), elevation * 100) AS upa FROM nodes", ("nodes",))
def _(t):
    return t.nodes.select("id", F.coalesce(F.nullif("darea", F.lit(50.0)), F.col("elevation") * 100).alias("upa"))


@query("o_s19_two_sources", "SELECT s.id, coalesce(nullif(s.darea, 0), t.darea / 100) AS upa FROM stations s LEFT JOIN targets t ON t.id = s.id", ("stations", "targets"))
def _(t):
    """Two sources in different units, the second where the first has no data."""
    other = t.targets.select("id", (F.col("darea") / 100).alias("other"))
    return t.stations.select("id", "darea").join(other, "id", "left").select("id", F.coalesce(F.nullif("darea", F.lit(0.0)), "other").alias("upa"))


@query("o_s21_cut_box", "SELECT s.id, s.x, s.y, s.darea FROM stations s WHERE x >= 1000 AND x < 5000 AND y >= 2000 AND y < 7000", ("stations",))
def _(t):
    s = t.stations
    return N.with_attributes(io.export_box(s.select("id", "x", "y"), 1000, 2000, 5000, 7000), s, "id", ["darea"])


@query("o_s22_diagnostics", "SELECT 'lines' AS name, count(*) AS n FROM lines UNION ALL SELECT 'lakes', count(*) FROM nodes WHERE is_lake = 1 UNION ALL SELECT 'dry', count(*) FROM cells WHERE NOT water", ("lines", "nodes", "cells"))
def _(t):
    table = {"lines": t.lines, "lakes": t.nodes.where("is_lake = 1"), "dry": t.cells.where("NOT water")}
    out = None
    for name, df in table.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("o_f01_inverse_ids", "SELECT id, length FROM lines WHERE id NOT IN (SELECT id FROM lines WHERE width > 900)", ("lines",))
def _(t):
    return t.lines.join(t.lines.where("width > 900").select("id"), "id", "left_anti").select("id", "length")


@query("o_f02_prune_components", "SELECT 'line' AS kind, id FROM lines WHERE start_node % 32 NOT IN (3, 5, 7) UNION ALL SELECT 'node', id FROM nodes WHERE id % 32 NOT IN (3, 5, 7)", ("lines", "nodes"))
def _(t):
    ids = t.spark.createDataFrame([(3,), (5,), (7,)], "comp long")
    lines, nodes = N.prune(t.lines.withColumn("comp", F.col("start_node") % 32), t.nodes.withColumn("comp", F.col("id") % 32), "comp", ids)
    return lines.select(F.lit("line").alias("kind"), "id").unionByName(nodes.select(F.lit("node").alias("kind"), "id"))


@query("o_f03_attribute_where", "SELECT id FROM nodes WHERE (grwl_value IN (126, 255) AND river_width > 200) OR elevation > 1500", ("nodes",))
def _(t):
    return t.nodes.where("(grwl_value IN (126, 255) AND river_width > 200) OR elevation > 1500").select("id")


@query("o_f04_complementary_split", "SELECT id, CASE WHEN grwl_value < 200 THEN 'bad' ELSE 'good' END AS part FROM nodes", ("nodes",))
def _(t):
    good, bad = N.split(t.nodes.select("id", "grwl_value"), F.col("grwl_value") < 200)
    return good.select("id", F.lit("good").alias("part")).unionByName(bad.select("id", F.lit("bad").alias("part")))


@query("o_f05_conditional_update", "SELECT id, coalesce(grwl_value, 0) AS grwl_value, greatest(river_width, 90) AS river_width, CASE WHEN is_lake = 1 THEN darea * 2 ELSE darea END AS darea FROM nodes", ("nodes",))
def _(t):
    return t.nodes.select("id", F.coalesce("grwl_value", F.lit(0)).alias("grwl_value"), F.greatest("river_width", F.lit(90.0)).alias("river_width"), F.when(F.col("is_lake") == 1, F.col("darea") * 2).otherwise(F.col("darea")).alias("darea"))


@query("o_f06_categorise", "SELECT CASE WHEN lower(concat(name, ' ', coalesce(other_tags, ''))) LIKE '%canal%' THEN 0 WHEN lower(name) LIKE '%pond%' THEN 0 WHEN lower(name) LIKE '%lake%' THEN 180 ELSE 255 END AS grwl_value, count(*) AS n FROM tags GROUP BY 1", ("tags",))
def _(t):
    row = F.lower(F.concat_ws(" ", "name", "other_tags"))
    kind = F.when(row.contains("canal") | row.contains("pond"), 0).when(row.contains("lake"), 180).otherwise(255)
    return t.tags.groupBy(kind.alias("grwl_value")).agg(F.count("*").alias("n"))


@query("o_f07_positive_class", "SELECT id, grwl_value FROM nodes WHERE coalesce(grwl_value, 0) > 0", ("nodes",))
def _(t):
    return t.nodes.where("grwl_value > 0").select("id", "grwl_value")


@query("o_f08_line_counts", "SELECT n.id, count(e.node) AS n_lines FROM nodes n LEFT JOIN (SELECT start_node AS node FROM loose_lines UNION ALL SELECT end_node FROM loose_lines) e ON e.node = n.id GROUP BY n.id", ("nodes", "loose_lines"))
def _(t):
    d = N.degrees(t.loose_lines).select(F.col("node").alias("id"), "n_lines")
    return N.with_attributes(t.nodes.select("id"), d, "id").fillna(0, ["n_lines"])


_DEGREE = "d AS (SELECT node, count(*) AS n, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT start_node AS node, 1 AS o, 0 AS i FROM lines UNION ALL SELECT end_node, 0, 1 FROM lines) e GROUP BY node)"


@query("o_f09_node_types", f"WITH {_DEGREE} SELECT id, CASE WHEN n = 1 AND type = 'sink' THEN 'sink_outlet' WHEN n = 1 AND type = 'coast' THEN 'coastal_outlet' WHEN n_out > 1 THEN 'bifurcation' WHEN n_in > 1 THEN 'confluence' WHEN n = 1 THEN 'inlet' ELSE 'confluence' END AS node_type FROM nodes JOIN d ON d.node = nodes.id", ("lines", "nodes"))
def _(t):
    d = N.degrees(t.lines).withColumnRenamed("node", "id")
    kind = F.when(F.col("n_out") > 1, "b").when(F.col("n_in") > 1, "c")
    return t.nodes.join(d, "id").select("id", S.node_type(F.lit(None).cast("string"), kind, F.col("type"), F.col("n_lines")).alias("node_type"))


@query("o_f10_flip_segments", "SELECT id, CASE WHEN id % 7 = 0 THEN end_node ELSE start_node END AS start_node, CASE WHEN id % 7 = 0 THEN start_node ELSE end_node END AS end_node, id % 7 = 0 AS flipped FROM lines", ("lines",))
def _(t):
    return N.flip(t.lines, t.lines.where("id % 7 = 0")).select("id", "start_node", "end_node", "flipped")


@query("o_f11_fix_links", "SELECT id, start_node, end_node FROM lines WHERE id % 5 = 0 UNION ALL SELECT id, end_node, start_node FROM lines WHERE id % 7 = 0", ("lines",))
def _(t):
    chosen = t.lines.where("id % 7 = 0")
    fixed = N.flip(chosen, chosen).select("id", "start_node", "end_node")
    return t.lines.where("id % 5 = 0").select("id", "start_node", "end_node").unionByName(fixed)


@query("o_f12_waterways", "SELECT id, waterway FROM tags WHERE waterway = 'river' OR waterway = 'canal'", ("tags",))
def _(t):
    return t.tags.where("waterway = 'river' OR waterway = 'canal'").select("id", "waterway")


@query("o_f13_keep_columns", "SELECT id, darea, is_outlet, is_lake FROM nodes", ("nodes",))
def _(t):
    import re

    df = t.nodes
    return df.select(*(c for c in df.columns if re.fullmatch("id|darea|is_.*", c)))


@query("o_f14_subset", "SELECT id AS reach_id, name, greatest(minx, 20) AS minx, greatest(miny, 10) AS miny, least(maxx, 60) AS maxx, least(maxy, 70) AS maxy, area FROM domains WHERE minx < 60 AND maxx > 20 AND miny < 70 AND maxy > 10 AND area > 10", ("domains",))
def _(t):
    both = t.domains.select(F.col("id").alias("global_id"), F.col("name").alias("name_left"), F.lit(0).alias("index_right"), "minx", "miny", "maxx", "maxy", "area")
    return io.subset(both, (20, 10, 60, 70), 10.0)


@query("o_f15_empty_table", "SELECT id, length FROM lines WHERE false", ("lines",))
def _(t):
    return io.empty(t.spark, "id long, length double")


@query("o_f16_name_like", "SELECT count(*) AS n, max(id) AS last FROM tags WHERE name LIKE '%Lake%' AND id > 10", ("tags",))
def _(t):
    return t.tags.where("name LIKE '%Lake%' AND id > 10").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("o_f17_bifurcations_off_lakes", f"WITH {_DEGREE} SELECT id FROM nodes JOIN d ON d.node = id WHERE n_out > 1 AND grwl_value <> 180", ("lines", "nodes"))
def _(t):
    d = N.degrees(t.lines).where("n_out > 1").select(F.col("node").alias("id"))
    return t.nodes.where("grwl_value <> 180").join(d, "id", "left_semi").select("id")


@query("o_u01_union_lines", "SELECT id, length FROM lines WHERE id % 2 = 0 UNION ALL SELECT id, length FROM loose_lines", ("lines", "loose_lines"))
def _(t):
    return t.lines.where("id % 2 = 0").select("id", "length").unionByName(t.loose_lines.select("id", "length"))


@query("o_u02_keyed_concat", "SELECT 'A' AS domain, id FROM lines WHERE id % 2 = 0 UNION ALL SELECT 'B', id FROM lines WHERE id % 2 = 1", ("lines",))
def _(t):
    return io.merge_layers({"A": t.lines.where("id % 2 = 0").select("id"), "B": t.lines.where("id % 2 = 1").select("id")}, "domain").select("domain", "id")


@query("o_u04_id_sets", "SELECT DISTINCT start_node AS id, 'only' AS part FROM lines WHERE start_node NOT IN (SELECT end_node FROM lines) UNION ALL SELECT DISTINCT start_node, 'both' FROM lines WHERE start_node IN (SELECT end_node FROM lines)", ("lines",))
def _(t):
    a, b = t.lines.select(F.col("start_node").alias("id")), t.lines.select(F.col("end_node").alias("id"))
    return a.exceptAll(a.join(b, "id", "left_semi")).distinct().withColumn("part", F.lit("only")).unionByName(a.intersect(b).withColumn("part", F.lit("both")))


@query("o_u05_pivot_stations", "SELECT nation, max(CASE WHEN k = 0 THEN darea END) AS p0, max(CASE WHEN k = 1 THEN darea END) AS p1, max(CASE WHEN k = 2 THEN darea END) AS p2 FROM (SELECT nation, id % 3 AS k, darea FROM stations) s GROUP BY nation", ("stations",))
def _(t):
    wide = t.stations.withColumn("k", F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))).groupBy("nation").pivot("k", ["p0", "p1", "p2"]).agg(F.max("darea"))
    return wide


@query("o_u06_key_value_wide", "SELECT region, sum(CASE WHEN k = 'east' THEN area END) AS east, sum(CASE WHEN k = 'west' THEN area END) AS west FROM (SELECT region, CASE WHEN minx >= 50 THEN 'east' ELSE 'west' END AS k, area FROM domains) d GROUP BY region", ("domains",))
def _(t):
    side = F.when(F.col("minx") >= 50, "east").otherwise("west")
    return t.domains.withColumn("k", side).groupBy("region").pivot("k", ["east", "west"]).agg(F.sum("area"))


@query("o_u07_explode_lists", "SELECT DISTINCT id AS line, start_node AS node FROM lines UNION SELECT id, end_node FROM lines", ("lines",))
def _(t):
    return N.node_table(t.lines).select(F.explode("line_cats").alias("line"), F.col("id").alias("node"))


@query("o_u08_replace_with_new_ids", "SELECT id, area FROM domains WHERE id % 6 <> 0 UNION ALL SELECT (SELECT max(id) FROM domains) + row_number() OVER (ORDER BY id, half), area / 2 FROM domains CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1) h WHERE id % 6 = 0", ("domains",))
def _(t):
    from pyspark.sql import Window

    kept = t.domains.where("id % 6 <> 0").select("id", "area")
    top = t.domains.agg(F.max("id").alias("top"))
    halves = t.domains.where("id % 6 = 0").select("id", (F.col("area") / 2).alias("area"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    new = halves.withColumn("k", F.row_number().over(Window.orderBy("id", "half"))).join(F.broadcast(top)).select((F.col("top") + F.col("k")).alias("id"), "area")  # one row per basin: small by nature
    return kept.unionByName(new)


@query("o_x01_angles", "SELECT id, abs(((start_node * 7 - end_node * 11 + 180) % 360 + 360) % 360 - 180) AS diff FROM lines", ("lines",))
def _(t):
    return t.lines.select("id", S.angle_difference(F.col("start_node") * 7, F.col("end_node") * 11).alias("diff"))


@query("o_x02_deviation_balance", "SELECT id, round((darea / river_width - 1) * 100, 6) AS dev, round((darea - elevation) / greatest(darea, elevation), 6) AS balance FROM nodes", ("nodes",))
def _(t):
    c = F.col
    return t.nodes.select("id", F.round(S.percent_deviation(c("darea"), c("river_width")), 6).alias("dev"), F.round(S.balance(c("darea"), c("elevation")), 6).alias("balance"))


@query("o_x03_cell_numbers", "SELECT x, y, x * 1000 + y AS idx, concat(CASE WHEN x - 50 >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(x - 50) AS VARCHAR), 9, '0'), '__N', lpad(CAST(y AS VARCHAR), 9, '0')) AS tile FROM cells", ("cells",))
def _(t):
    return t.cells.select("x", "y", S.cell_number(F.col("x") + 1, F.col("y") + 1, 1000).alias("idx"), S.tile_name(F.col("x") - 50, F.col("y")).alias("tile"))


@query("o_x04_tags", """SELECT id, coalesce(nullif(regexp_extract(other_tags, '"name:en"=>"([^"]*)"', 1), ''), nullif(regexp_extract(other_tags, '"int_name"=>"([^"]*)"', 1), '')) AS name FROM tags""", ("tags",))
def _(t):
    return t.tags.select("id", S.first_tag(S.parse_tags(F.col("other_tags")), "name:en", "int_name", "name:fr").alias("name"))


@query("o_x05_envelopes", "SELECT id, (maxx - minx) * (maxy - miny) AS envelope, area / ((maxx - minx) * (maxy - miny)) AS compactness FROM domains", ("domains",))
def _(t):
    box = S.box_area(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return t.domains.select("id", box.alias("envelope"), (F.col("area") / box).alias("compactness"))


@query("o_x06_strings", "SELECT id, concat('component_', lpad(CAST(id % 10000 AS VARCHAR), 4, '0')) AS name, lower(waterway) AS waterway, round_even(CAST(id AS DOUBLE) * CAST(0.125 AS DOUBLE), 2) AS r FROM tags", ("tags",))
def _(t):
    return t.tags.select("id", F.format_string("component_%04d", F.col("id") % 10000).alias("name"), F.lower("waterway").alias("waterway"), F.bround(F.col("id") * F.lit(0.125), 2).alias("r"))


@query(
    "o_x07_line_measures",
    "WITH s AS (SELECT id, pos, x, y, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM wide_vertices WINDOW w AS (PARTITION BY id ORDER BY pos)), m AS (SELECT id, coalesce(sum(sqrt(power(tx - x, 2) + power(ty - y, 2))), 0) AS length, arg_max(x, pos) - arg_min(x, pos) AS dx, arg_max(y, pos) - arg_min(y, pos) AS dy FROM s GROUP BY id) SELECT id, round(length, 6) AS length, round((degrees(atan2(dx, dy)) + 360) % 360, 6) AS azimuth, round(CASE WHEN dx <> 0 OR dy <> 0 THEN length / sqrt(dx * dx + dy * dy) END, 6) AS sinuosity FROM m",
    ("wide_vertices",),
)
def _(t):
    return G.line_measures(t.wide_vertices).select("id", *(F.round(c, 6).alias(c) for c in ("length", "azimuth", "sinuosity")))


_ARCS = "a AS (SELECT id, pos, x, y, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM wide_vertices WINDOW w AS (PARTITION BY id ORDER BY pos)), g AS (SELECT *, sqrt(power(tx - x, 2) + power(ty - y, 2)) / 30 AS st, round(sqrt(power(tx - x, 2) + power(ty - y, 2)) / sqrt(1800), 14) AS di FROM a WHERE tx IS NOT NULL), n AS (SELECT *, CAST(CASE WHEN st > 1 AND st = floor(st) THEN st WHEN di > 1 AND di = floor(di) THEN di ELSE 1 END AS INTEGER) AS n FROM g)"


@query(
    "o_x08_dense_lines",
    f"WITH {_ARCS}, f AS (SELECT id, pos, k, x + (tx - x) * k / n AS x, y + (ty - y) * k / n AS y FROM n JOIN (SELECT CAST(unnest(range(1, 400)) AS INTEGER) AS k) q ON k <= n UNION ALL SELECT id, pos, 0, x, y FROM wide_vertices WHERE pos = 0) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos, k) - 1 AS INTEGER) AS pos, round(x, 6) AS x, round(y, 6) AS y FROM f",
    ("wide_vertices",),
)
def _(t):
    return G.dense_lines(t.wide_vertices).select("id", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("o_x08_missing_vertices", "SELECT v.id, v.pos, v.pos = 0 OR v.pos = hi AS at_end FROM (SELECT *, max(pos) OVER (PARTITION BY id) AS hi FROM vertices) v WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.x * 30 = v.x AND c.y * 30 = v.y)", ("vertices", "cells"))
def _(t):
    at = t.cells.select((F.col("x") * 30).cast("double").alias("x"), (F.col("y") * 30).cast("double").alias("y"))
    return G.missing_vertices(t.vertices.select("id", "pos", "x", "y"), at)


@query(
    "o_x09_joining_lines",
    "WITH p AS (SELECT s.id, s.x AS ax, s.y AS ay, t.x AS bx, CASE WHEN s.id % 3 = 0 THEN s.y ELSE t.y END AS b_y FROM stations s JOIN targets t ON t.id = s.id), d AS (SELECT *, abs(ax - bx) AS dx, abs(ay - b_y) AS dy, least(abs(ax - bx), abs(ay - b_y)) AS sh FROM p) SELECT id, 0 AS pos, ax AS x, ay AS y FROM d UNION ALL SELECT id, 1, ax - sh * sign(ax - bx), ay - sh * sign(ay - b_y) FROM d WHERE sh > 0 AND dx <> dy UNION ALL SELECT id, CASE WHEN sh > 0 AND dx <> dy THEN 2 ELSE 1 END, bx, b_y FROM d",
    ("stations", "targets"),
)
def _(t):
    to = t.targets.select("id", F.col("x").alias("bx"), F.col("y").alias("ty"))
    pairs = t.stations.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(to, "id").withColumn("by", F.when(F.col("id") % 3 == 0, F.col("ay")).otherwise(F.col("ty")))
    return G.joining_lines(pairs)


@query("o_x10_powers", "SELECT id, round(log10(darea), 6) AS log_area, round(power(darea, 0.43), 6) AS area_043, round(power(darea, 0.32), 6) AS area_032, round(power(river_width / 9.6, 1 / 0.32), 2) AS width_inverse FROM nodes", ("nodes",))
def _(t):
    p = S.powers(F.col("river_width"), F.col("darea"))
    return t.nodes.select("id", p.alias("p")).select("id", *(F.round(f"p.{c}", 6).alias(c) for c in ("log_area", "area_043", "area_032")), F.round("p.width_inverse", 2).alias("width_inverse"))


@query("o_x11_arrays", "WITH a AS (SELECT start_node AS node, list(id ORDER BY id) AS ids FROM lines GROUP BY 1) SELECT node, CAST(list_position(ids, node) - 1 AS BIGINT) AS at, array_to_string(list_concat(list_concat(ids[1:1], [CAST(-1 AS BIGINT)]), ids[2:]), ',') AS with_new FROM a", ("lines",))
def _(t):
    a = t.lines.groupBy(F.col("start_node").alias("node")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    text = F.concat_ws(",", F.transform(S.insert_at(F.col("ids"), F.lit(1), F.lit(-1).cast("long")), lambda i: i.cast("string")))
    return a.select("node", (F.array_position("ids", F.col("node")) - 1).alias("at"), text.alias("with_new"))


@query("o_x12_areas", "SELECT id, area / 1000000 AS km2, area * 0.0001 AS hectares, area / 900 AS cells FROM domains", ("domains",))
def _(t):
    return t.domains.select("id", *(S.area_units(F.col("area"))[k].alias(k) for k in ("km2", "hectares", "cells")))


@query("o_l01_ordered_pairs", "SELECT least(start_node, end_node) AS a, greatest(start_node, end_node) AS b, min(length) AS shortest, count(*) AS n FROM messy_lines GROUP BY 1, 2 HAVING count(*) > 1", ("messy_lines",))
def _(t):
    return N.parallel_lines(t.messy_lines).where("rank = 1").select(F.least("start_node", "end_node").alias("a"), F.greatest("start_node", "end_node").alias("b"), F.col("length").alias("shortest"), F.col("n_parallel").alias("n")).unionByName(
        t.messy_lines.where("start_node = end_node").groupBy(F.col("start_node").alias("a"), F.col("end_node").alias("b")).agg(F.min("length").alias("shortest"), F.count("*").alias("n")).where("n > 1")
    )
