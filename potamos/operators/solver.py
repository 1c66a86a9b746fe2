"""What a direction solver takes and gives: node and link tables, pruning, raster segments, drainage from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potamos.functions import scalars as S

from . import network as N
from .components import connected_components
from .geometry import dense_lines
from .graph import bridges, cycle_report, levels, peel_leaves
from .lineage import settle


def solver_nodes(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node table of the direction solver: ``(id, conn, n_lines, outlet, inlet, coastal, single_flow, component,
    accumulation, synthetic_elevation, mainchannel_darea)``. ``nodes`` is ``(id, type, grwl_value, darea, comp,
    outlet_distance, mainchannel_darea)``.

    Flow is single where the class is null. A component of single flow only keeps the one outlet of greatest
    accumulation (smallest id on ties). Other nodes of one line are inlets, and so are interbasin nodes."""
    conn = N.node_table(lines).select("id", F.concat_ws(",", F.transform("line_cats", lambda i: i.cast("string"))).alias("conn"), "n_lines")
    n = nodes.join(conn, "id").withColumn("single", F.col("grwl_value").isNull()).withColumn("was", F.coalesce(F.col("type") == "outlet", F.lit(False)))
    parts = n.groupBy("comp").agg(F.bool_and("single").alias("only"), F.min(F.when(F.col("was"), F.struct((-F.coalesce("darea", F.lit(-1e300))).alias("d"), "id"))).alias("top"))
    n = n.join(parts, "comp")
    outlet = F.col("was") & (~F.col("only") | (F.col("id") == F.col("top.id")))
    inlet = ((F.col("n_lines") == 1) & ~outlet) | F.coalesce(F.col("type") == "interbasin", F.lit(False))
    flag = lambda c, name: c.cast("int").alias(name)
    return n.select(
        "id", "conn", "n_lines", flag(outlet, "outlet"), flag(inlet, "inlet"), flag(F.coalesce(F.col("grwl_value") == 126, F.lit(False)), "coastal"), flag(F.col("single"), "single_flow"),
        F.col("comp").alias("component"), F.col("darea").alias("accumulation"), F.col("outlet_distance").alias("synthetic_elevation"), "mainchannel_darea",
    )


def solver_links(lines: DataFrame, cells: DataFrame, node_cells: DataFrame, default_width: float = 30.0) -> DataFrame:
    """Link table of the direction solver. ``cells`` is ``(id, pos, idx, width, darea, elev)``, the cells along each
    line; a null ``idx`` is a place without a cell. ``node_cells`` is ``(node, idx)``.

    Places without a cell are left out, but a missing start or end gets the cell of its node and the mean width of the
    line, or ``default_width`` where the line has none. Lists are texts of comma-joined whole numbers. Gradients are
    medians of the last half less those of the first."""
    ends = Window.partitionBy("id")
    c = cells.withColumns({"first": F.min("pos").over(ends), "last": F.max("pos").over(ends), "mean_width": F.avg(F.when(F.col("idx").isNotNull(), F.col("width"))).over(ends)})
    c = c.join(lines.select("id", "start_node", "end_node"), "id")
    missing_end = F.col("idx").isNull() & ((F.col("pos") == F.col("first")) | (F.col("pos") == F.col("last")))
    node = F.when(F.col("pos") == F.col("first"), F.col("start_node")).otherwise(F.col("end_node"))
    c = c.where(F.col("idx").isNotNull() | missing_end).withColumn("node", F.when(missing_end, node))
    c = c.join(node_cells.select("node", F.col("idx").alias("node_idx")), "node", "left")
    listed = c.select("id", "pos", F.coalesce("idx", "node_idx").alias("idx"), F.when(F.col("idx").isNull(), F.coalesce("mean_width", F.lit(default_width))).otherwise(F.col("width")).alias("width"))
    as_text = lambda name: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", name))), lambda x: x[name].cast("long").cast("string"))).alias(f"{name}_list")
    lists = listed.groupBy("id").agg(as_text("idx"), as_text("width"), F.count("*").alias("length_cells"))
    held = cells.where("idx IS NOT NULL")
    k, n = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1, F.count("*").over(ends)
    held = held.withColumns({"k": k, "n": n}).withColumn("half", F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    median = lambda name, start: F.percentile(F.when(F.col("k") < F.col("half") if start else F.col("k") >= F.col("n") - F.col("half"), F.col(name)), F.lit(0.5))
    halves = held.groupBy("id").agg(median("darea", True).alias("darea_start"), median("darea", False).alias("darea_end"), median("elev", True).alias("elevation_start"), median("elev", False).alias("elevation_end"))
    halves = halves.withColumns({"darea_gradient": F.col("darea_end") - F.col("darea_start"), "elevation_gradient": F.col("elevation_end") - F.col("elevation_start")})
    return lines.select("id", "start_node", "end_node").join(lists, "id", "left").join(halves, "id", "left").join(inner_bridges(lines), "id", "left").withColumn("bridge", F.coalesce("bridge", F.lit(0)))


def inner_bridges(lines: DataFrame) -> DataFrame:
    """``(id, bridge)`` with 1 for bridges that aren't dangles: both ends have several neighbours."""
    around = lines.select(F.col("start_node").alias("node"), F.col("end_node").alias("other")).union(lines.select("end_node", "start_node"))
    wide = around.groupBy("node").agg(F.countDistinct("other").alias("k")).where("k > 1").select("node")
    inside = lines.select("id", "start_node", "end_node").join(bridges(lines), "id", "left_semi")
    inside = inside.join(wide.select(F.col("node").alias("start_node")), "start_node", "left_semi").join(wide.select(F.col("node").alias("end_node")), "end_node", "left_semi")
    return inside.select("id", F.lit(1).alias("bridge"))


def prune_single_flow(lines: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Peel lines of single flow from their tips inwards. ``nodes`` is ``(id, single_flow, outlet)``, flags of 0 and 1.

    Returns the lines that are left, ``(id, round, reversed)`` for the others (reversed where the line led towards its
    tip), and the nodes that are left with ``n_lines`` and ``inlet``. A tip goes if it and the node behind it are of
    single flow and it is no outlet; outlets left without a line go as well. Lines with undefined ends (below 1) go
    last, with the nodes that they leave without a line."""
    may_go = nodes.where("single_flow = 1").select(F.col("id").alias("node"))
    tips = may_go.join(nodes.where("outlet = 1").select(F.col("id").alias("node")), "node", "left_anti")
    peeled = peel_leaves(lines, may_go, tips)
    left = lines.join(peeled, "id", "left_anti")
    had = N.incidence(lines).select(F.col("node").alias("id")).distinct()
    counted = nodes.join(N.degrees(left).select(F.col("node").alias("id"), "n_lines"), "id", "left").fillna(0, ["n_lines"])
    counted = counted.join(had, "id", "left_semi").where("n_lines > 0").withColumn("inlet", ((F.col("n_lines") == 1) & (F.col("outlet") == 0)).cast("int"))
    whole = left.where("start_node > 0 AND end_node > 0")
    still = N.incidence(whole).select(F.col("node").alias("id")).distinct()
    return whole, peeled, counted.join(still, "id", "left_semi")


def raster_segments(lines: DataFrame, vertices: DataFrame, res: float = 30.0, trim: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The network as cells: ``(id, pos, x, y)`` of every line, dense and, with ``trim``, without the cells of its
    nodes; ``(node, upstream_segments, downstream_segments, bifurcation, x, y)`` with lists by id, the place being the last vertex of
    the first line above or else the first of the first line below; and the lines that have both nodes."""
    dense = dense_lines(vertices, res)
    lists = lambda key, name: lines.groupBy(F.col(key).alias("node")).agg(F.sort_array(F.collect_list("id")).alias(name))
    nodes = lists("end_node", "upstream_segments").join(lists("start_node", "downstream_segments"), "node", "full_outer")
    none = F.expr("cast(array() as array<bigint>)")
    nodes = nodes.select("node", F.coalesce("upstream_segments", none).alias("upstream_segments"), F.coalesce("downstream_segments", none).alias("downstream_segments"))
    ends = dense.groupBy("id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"), F.max("pos").alias("top"))
    nodes = nodes.withColumn("id", F.coalesce(F.try_element_at("upstream_segments", F.lit(1)), F.try_element_at("downstream_segments", F.lit(1)))).join(ends, "id", "left")
    at = F.when(F.size("upstream_segments") > 0, F.col("b")).otherwise(F.col("a"))
    nodes = nodes.select("node", "upstream_segments", "downstream_segments", (F.size("downstream_segments") > 1).alias("bifurcation"), at["x"].alias("x"), at["y"].alias("y"))
    if trim:
        dense = dense.join(ends.select("id", "top"), "id").where("pos > 0 AND pos < top").select("id", "pos", "x", "y")
    return dense, nodes, lines.where("start_node > 0 AND end_node > 0")


def drainage(lines: DataFrame, vertices: DataFrame, res: float = 30.0) -> DataFrame:
    """``(x, y, code)``: D8 codes along directed lines. A line's last cell belongs to the next line; at a bifurcation the first
    line besides the widest (smallest ids) starts a cell later; outlets get 0; where cells meet the least code counts."""
    dense, nodes, _ = raster_segments(lines, vertices, res, trim=False)
    w = Window.partitionBy("start_node")
    branch = lines.select("id", "start_node", (F.row_number().over(w.orderBy(F.desc("width"), "id")) == 1).alias("main"))
    second = branch.where("NOT main").groupBy("start_node").agg(F.min("id").alias("id")).select("id", F.lit(1).alias("late"))
    along = Window.partitionBy("id").orderBy("pos")
    steps = dense.join(second, "id", "left").where("late IS NULL OR pos > 0")
    to = lambda c: F.lead(c).over(along) - F.col(c)
    steps = steps.withColumns({"dx": to("x"), "dy": to("y")}).where("dx IS NOT NULL")
    codes = steps.select("x", "y", S.d8_code(F.col("dx"), F.col("dy")).alias("code"))  # steps longer than a cell keep their direction
    outlets = nodes.where(F.size("downstream_segments") == 0).select("x", "y", F.lit(0).alias("code"))
    return codes.unionByName(outlets).groupBy("x", "y").agg(F.min("code").alias("code"))


def components_of(lines: DataFrame) -> DataFrame:
    return connected_components(lines.select(F.col("start_node").alias("src"), F.col("end_node").alias("dst")))


def take_directions(lines: DataFrame, flipped: DataFrame, node_facts: DataFrame) -> DataFrame:
    """``(id, start_node, end_node, flipped, level, ...)``: a solver's directions taken over. Lines in ``flipped`` are turned,
    those on directed cycles or with undefined ends go, levels follow, and the facts of start nodes are joined."""
    turned = settle(N.flip(lines, flipped).select("id", "start_node", "end_node", "flipped"))
    on_cycles, _ = cycle_report(turned)
    kept = settle(turned.where("start_node >= 0 AND end_node >= 0").join(on_cycles, "id", "left_anti"))
    facts = node_facts.withColumnRenamed("id", "start_node")
    return kept.join(levels(kept), "id").join(facts, "start_node", "left").select("id", "start_node", "end_node", "flipped", "level", *(c for c in facts.columns if c != "start_node"))
