"""Networks, cells, stations and other tables derived from the driver's tables.

Each table is one SQL text that Spark and DuckDB both run: ``//`` is integer division, ``{name}`` another table.
Lengths, widths and cell values are whole numbers kept as doubles, so sums don't depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DERIVED: dict[str, str] = {
    # a directed acyclic network with bifurcations
    "lines": """
        SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS start_node, CAST(p_partkey // 2 AS BIGINT) AS end_node,
               CAST(floor(p_retailprice) AS DOUBLE) AS length, CAST(30 * p_size AS DOUBLE) AS width
        FROM {part} WHERE p_partkey >= 64
        UNION ALL
        SELECT CAST(p_partkey + 10000000 AS BIGINT), CAST(p_partkey AS BIGINT), CAST(p_partkey // 4 AS BIGINT),
               CAST(floor(p_retailprice / 2) AS DOUBLE), CAST(15 * (p_size + p_partkey % 7) AS DOUBLE)
        FROM {part} WHERE p_partkey % 5 = 0 AND p_partkey >= 128""",
    # the same with self loops, parallel lines, directed cycles and undefined ends
    "messy_lines": """
        SELECT id, start_node, end_node, length, width FROM {lines}
        UNION ALL
        SELECT id + 20000000, end_node, start_node, length, width FROM {lines} WHERE id % 97 = 0
        UNION ALL
        SELECT id + 30000000, start_node, start_node, length, width FROM {lines} WHERE id % 101 = 0
        UNION ALL
        SELECT id + 40000000, start_node, end_node, length + 100, width FROM {lines} WHERE id % 53 = 0
        UNION ALL
        SELECT id + 50000000, start_node, CAST(-1 AS BIGINT), length, width FROM {lines} WHERE id % 211 = 0""",
    # pieces: a fifth of the lines is gone; braids, parallel lines and lines of both directions are left
    "loose_lines": "SELECT id, start_node, end_node, length, width FROM {messy_lines} WHERE start_node % 5 <> 3 AND end_node >= 0 AND start_node <> end_node",
    "nodes": """
        SELECT n AS id, CAST(50 + (n * 37) % 1000 AS DOUBLE) AS darea, CAST(n AS DOUBLE) AS elevation,
               CASE n % 4 WHEN 0 THEN 255 WHEN 1 THEN 180 WHEN 2 THEN 126 END AS grwl_value,
               CAST(30 + (n % 50) * 10 AS DOUBLE) AS river_width, CASE WHEN n < 64 THEN 1 ELSE 0 END AS is_outlet,
               CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS is_lake, CASE WHEN n % 11 = 0 THEN 'sink' WHEN n % 13 = 0 THEN 'coast' WHEN n % 17 = 5 THEN 'interbasin' END AS type
        FROM (SELECT start_node AS n FROM {lines} UNION SELECT end_node FROM {lines}) e""",
    # what a direction solver knows of nodes: the component is the outlet below, some are of single flow only
    "net_nodes": """
        SELECT id, comp, CASE WHEN id < 64 OR id % 37 = 1 THEN 'outlet' WHEN id % 41 = 0 THEN 'interbasin' END AS type,
               CASE WHEN comp % 4 = 3 THEN NULL ELSE grwl_value END AS grwl_value, darea, elevation * 30 AS outlet_distance, darea * 2 AS mainchannel_darea
        FROM (SELECT n.*, CAST(id // CASE """ + " ".join(f"WHEN id < {64 << k} THEN {1 << k}" for k in range(36)) + """ END AS BIGINT) AS comp FROM {nodes} n) c""",
    # cells along lines, some without a cell in the grid
    "line_cells": """
        SELECT id, pos, CASE WHEN (id * 3 + pos) % 7 = 0 THEN NULL ELSE CAST(id * 10 + pos AS BIGINT) END AS idx,
               CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(30 * (1 + (id + pos) % 5) AS DOUBLE) END AS width, value AS darea, CAST((id * 11 + pos * 17) % 300 AS DOUBLE) AS elev
        FROM {vertices}""",
    # vertices whose arcs span several cells, straight, diagonal or neither
    "wide_vertices": """
        SELECT id, pos, CAST(id % 500 * 30 + CASE id % 4 WHEN 0 THEN pos * pos * 30 WHEN 1 THEN pos * 90 WHEN 2 THEN -pos * 60 ELSE pos * 45 END AS DOUBLE) AS x,
               CAST(id % 300 * 30 + CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN pos * 90 WHEN 2 THEN pos * (pos + 1) * 30 ELSE pos * 70 END AS DOUBLE) AS y
        FROM {vertices}""",
    # short parts of segments with their middles
    "reach_pieces": """
        SELECT id, CAST(pos AS INT) AS seq, CAST(100 + (id * 7 + pos * 13) % 100 AS DOUBLE) AS length,
               CAST((id * 7919) % 9001 + pos * (id % 9) * 60 AS DOUBLE) AS x, CAST((id * 104729) % 9001 + pos * (id % 7) * 80 AS DOUBLE) AS y
        FROM {lines} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) p
        WHERE pos <= id % 7 + 2""",
    "named_points": "SELECT s.id, s.x, s.y, t.name, t.other_tags FROM {stations} s JOIN {tags} t ON t.id = s.id",
    # lines some of which have lost their names, in components
    "named_lines": """
        SELECT l.id, l.start_node, l.end_node, l.length, n.comp, CASE WHEN l.id % 4 = 0 THEN concat('r', CAST(l.end_node % 5 AS VARCHAR(10))) END AS name
        FROM {lines} l JOIN {net_nodes} n ON n.id = l.start_node""",
    # fix lines laid over segments, with the angle of both
    "fix_matches": """
        SELECT id AS line, start_node, end_node, CAST(id % 40 AS DOUBLE) / 39 AS share, CAST(id * 13 % 360 AS DOUBLE) AS azimuth,
               CASE WHEN id % 40 <= 35 THEN CAST(id * 29 % 360 AS DOUBLE) WHEN id % 3 = 0 THEN CAST((id * 13 + 176) % 360 AS DOUBLE) ELSE CAST((id * 13 + id % 7) % 360 AS DOUBLE) END AS fix_azimuth
        FROM {lines}""",
    # components of three domains, in part the same nodes
    "shared_nodes": """
        SELECT CAST(id % 3 AS BIGINT) AS domain, CAST(id // 30 + 100 * (id % 3) + CASE WHEN id % 3 = 2 AND id % 60 < 15 THEN 1000 ELSE 0 END AS BIGINT) AS comp,
               CAST(id // 6 AS BIGINT) + CASE WHEN id % 5 = 1 THEN 100000 * (id % 3) ELSE 0 END AS x, CAST(id % 2 AS BIGINT) AS y FROM {stations}""",
    # polygons inside the boxes of the domains: a diamond each
    "diamonds": """
        SELECT id, minx, miny, maxx, maxy, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM {domains}""",
    # bands of a river raster: class of water, land, distance to the coast, half widths, lines, lakes, drainage
    "raster": """
        SELECT x, y, elev, value, CASE WHEN water THEN CASE (x * 31 + y * 17) % 5 WHEN 0 THEN 126 WHEN 1 THEN 180 WHEN 2 THEN 180 ELSE 255 END END AS grwl,
               x < 70 AS land, CAST(abs(x - 70) * 30 AS DOUBLE) AS coast_dist, CASE WHEN water THEN CAST(15 * (1 + (x + y) % 7) AS DOUBLE) END AS halfwidth,
               (x + y) % 6 = 0 AS centre, (x * 7 + y) % 11 = 0 AS osm, (x + y * 5) % 9 = 0 AS osm_small, CASE WHEN (x * 3 + y) % 10 < 4 THEN CAST((x * 13 + y * 7) % 500 AS DOUBLE) END AS end_dist,
               value > 950 AS river, CASE WHEN (x * 3 + y * 5) % 7 = 0 THEN CAST(zx * 1000 + zy AS BIGINT) END AS lake, (zx + zy) % 13 = 0 AS closed,
               CASE WHEN (x + 2 * y) % 5 = 0 THEN x // 10 * 100 + y // 10 END AS segment, value * 10 AS accum, x % 37 = 0 AND y % 11 = 0 AS outlet,
               CASE WHEN (x * x + y) % 3 > 0 THEN CAST(x // 10 * 100 + y // 10 AS BIGINT) END AS reach_id
        FROM {cells}""",
    "reach_table": """
        SELECT DISTINCT reach_id, reach_id % 1000 // 2 AS segment_id, reach_id % 7 + 1 AS catchment_id FROM {raster} WHERE reach_id IS NOT NULL""",
    # vertices of each line
    "vertices": """
        SELECT id, pos, CAST(start_node % 1000 * 30 + pos * 30 AS DOUBLE) AS x, CAST(end_node % 1000 * 30 + (pos * pos) % 5 * 30 AS DOUBLE) AS y,
               CAST((id * 7 + pos * 13) % 100 AS DOUBLE) AS value
        FROM {lines} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) p
        WHERE pos <= id % 4 + 2""",
    "cells": """
        SELECT CAST(event_id % 100 AS BIGINT) AS x, CAST(event_id // 100 AS BIGINT) AS y, CAST(floor(value * 10) AS DOUBLE) AS value,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS elev, value > 60 AS water,
               event_type AS class, CAST(event_id % 100 // 10 AS BIGINT) AS zx, CAST(event_id // 1000 AS BIGINT) AS zy
        FROM {events}""",
    "stations": """
        SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10007 AS DOUBLE) AS y,
               CAST(floor(abs(c_acctbal)) AS DOUBLE) AS darea, c_nationkey AS nation FROM {customer}""",
    "targets": """
        SELECT CAST(s_suppkey AS BIGINT) AS id, CAST((s_suppkey * 7919 + 13) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104729 + 29) % 10007 AS DOUBLE) AS y,
               CAST(floor(abs(s_acctbal)) AS DOUBLE) AS darea, s_nationkey AS nation FROM {supplier}""",
    # bounding boxes with an area below that of the box
    "domains": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST((n_nationkey * 37) % 100 AS DOUBLE) AS minx,
               CAST((n_nationkey * 53) % 100 AS DOUBLE) AS miny, CAST((n_nationkey * 37) % 100 + 15 + n_nationkey % 5 AS DOUBLE) AS maxx,
               CAST((n_nationkey * 53) % 100 + 10 + n_nationkey % 7 AS DOUBLE) AS maxy,
               CAST((15 + n_nationkey % 5) * (10 + n_nationkey % 7) // (1 + n_nationkey % 3) AS DOUBLE) AS area
        FROM {nation}""",
    # basins side by side inside each region, in part over each other
    "basins": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey // 5 * 13 AS DOUBLE) AS minx, CAST(0 AS DOUBLE) AS miny,
               CAST(n_nationkey // 5 * 13 + 14 + n_nationkey // 5 % 3 AS DOUBLE) AS maxx, CAST(12 + n_regionkey AS DOUBLE) AS maxy,
               CAST((14 + n_nationkey // 5 % 3) * (12 + n_regionkey) - n_nationkey AS DOUBLE) AS area
        FROM {nation}""",
    "comparison": """
        SELECT CAST((l_orderkey * 37 + l_linenumber * 53) % 181 AS DOUBLE) AS azimuth_diff, CAST(floor(l_quantity * 2) AS DOUBLE) AS snap_dist,
               CAST(floor(l_extendedprice) AS BIGINT) % 100 AS avgwidth, CAST(floor(l_quantity) * 10 AS DOUBLE) AS length_split,
               l_returnflag AS delta_name, l_linestatus AS domain_id FROM {lineitem}""",
    "tags": """
        SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Mill Pond' WHEN p_partkey % 7 = 0 THEN 'Grand Canal' WHEN p_partkey % 5 = 0 THEN 'Blue Lake' ELSE p_name END AS name,
               CASE WHEN p_partkey % 4 = 0 THEN concat('"name:en"=>"', p_brand, '","width"=>"', CAST(p_size AS VARCHAR(10)), '"')
                    WHEN p_partkey % 4 = 1 THEN concat('"int_name"=>"', p_brand, '"') END AS other_tags,
               CASE WHEN p_partkey % 2 = 0 THEN 'river' WHEN p_partkey % 3 = 1 THEN 'canal' WHEN p_partkey % 11 <> 0 THEN 'ditch' END AS waterway FROM {part}""",
}


def needs(name: str) -> list[str]:
    """Derived tables that ``name`` reads, itself last."""
    found: list[str] = []
    for x in re.findall(r"\{(\w+)\}", DERIVED[name]):
        if x in DERIVED:
            found += [y for y in needs(x) if y not in found]
    return [*found, name]


def duckdb_with(names: tuple[str, ...]) -> str:
    """``WITH`` clause that defines the tables for DuckDB."""
    order: list[str] = []
    for name in names:
        order += [x for x in needs(name) if x not in order]
    return "WITH RECURSIVE " + ", ".join(f"{x} AS ({re.sub(r'[{}]', '', DERIVED[x])})" for x in order)


class Tables:
    """The driver's tables and those derived from them, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DERIVED:
            raise AttributeError(name)
        text = DERIVED[name]
        return self.spark.sql(text.replace("//", " DIV "), **{x: getattr(self, x) for x in set(re.findall(r"\{(\w+)\}", text))})
