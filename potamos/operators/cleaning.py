"""Composite network operators: cleaning, cycle removal, end snapping, splitting, directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import network as N
from . import spatial as P
from .components import connected_components
from .graph import bridges, pair_distances, shortest_paths
from .lineage import release, settle

def _components(lines: DataFrame) -> DataFrame:
    return connected_components(lines.select(F.col("start_node").alias("src"), F.col("end_node").alias("dst")))


def clean_network(lines: DataFrame, nodes: DataFrame, factor: float = 1.0, lake_factor: float = 2.0, min_accum: float = 50.0, rounds: int | None = None) -> DataFrame:
    """Lines without self loops and short dangles, after ``rounds`` rounds or, by default, when nothing goes any more.

    A dangle has exactly one tip: a node of one line that no round before has visited. It is short if its length is below the width of its
    wider node (smaller id on ties) times ``factor``, or both nodes are lakes and it is below that times ``lake_factor``.
    Of the short ones that share the wider node, the shortest with an outlet stays, even alone, and of the others the
    longest where there are several. A dangle whose tip drains at least ``min_accum`` and is no lake stays. Nodes that
    were tips are out of all later rounds, so what stayed once stays."""
    left = settle(lines.where("start_node <> end_node"))
    n = nodes.select(F.col("id").alias("node"), "river_width", "is_lake", "darea", "is_outlet")
    visited, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        tips = N.degrees(left).where("n_lines = 1").select("node")
        tips = settle(tips if visited is None else tips.join(visited, "node", "left_anti"))
        ends = N.incidence(left)
        single = ends.join(tips, "node").groupBy("line").agg(F.count("*").alias("k"), F.min("node").alias("tip")).where("k = 1").drop("k")
        at = ends.join(single, "line").join(n, "node", "left")
        at = at if visited is None else at.join(visited, "node", "left_anti")
        facts = at.groupBy("line", "tip").agg(
            F.max("river_width").alias("least"), F.min_by("node", F.struct((-F.coalesce("river_width", F.lit(-1.0))).alias("w"), "node")).alias("node"),
            F.min("is_lake").alias("lake"), F.max("is_outlet").alias("outlet"),
            F.max(F.when(F.col("node") == F.col("tip"), F.col("darea"))).alias("tip_darea"), F.max(F.when(F.col("node") == F.col("tip"), F.col("is_lake"))).alias("tip_lake"),
        )
        facts = facts.join(left.select(F.col("id").alias("line"), "length"), "line")
        short = facts.where((F.col("length") < F.col("least") * factor) | ((F.col("lake") == 1) & (F.col("length") < F.col("least") * lake_factor)))
        first = F.row_number().over(Window.partitionBy("node", "outlet").orderBy("length", "line"))
        short = short.withColumn("first", first).where("NOT (coalesce(outlet, 0) = 1 AND first = 1)")
        w = Window.partitionBy("node")
        short = short.withColumns({"k": F.count("*").over(w), "last": F.row_number().over(w.orderBy(F.desc("length"), "line"))}).where("NOT (k > 1 AND last = 1)")
        gone = settle(short.where(~F.coalesce((F.col("tip_darea") >= min_accum) & (F.col("tip_lake") != 1), F.lit(False))).select(F.col("line").alias("id")))
        if gone.isEmpty():
            release(gone, tips, visited)
            break
        left = settle(left.join(gone, "id", "left_anti"), left)
        visited = settle(tips if visited is None else visited.unionByName(tips), visited)
        release(gone, tips)
    return left


def snap_ends(lines: DataFrame, nodes: DataFrame, dmin: float, dmax: float, min_loop: float = 1000.0, factor: float = 1.0) -> DataFrame:
    """``(a, b, dist, loop, n_between)``: pairs of free ends that a new line may join. ``nodes`` is ``(id, x, y, river_width,
    is_end)``, ``is_end`` marking nodes of a kind that may be joined.

    Each free end looks for the nearest other end at ``dmin`` to ``dmax``; pairs found from both sides are one. A pair
    joins if there is no way between its ends (loop and n_between are null), or if the shortest way with the new line
    is longer than ``min_loop``, the way of fewest nodes has more than one between, and one of the two end lines is no
    short dangle: as long as the wider of its nodes times ``factor``, or without another line at either end."""
    lines = lines.where("start_node <> end_node")
    degree = N.degrees(lines).select("node", "n_lines")
    free = degree.where("n_lines = 1").select(F.col("node").alias("id"))
    ends = nodes.join(free, "id", "left_semi")
    others = ends.where("is_end").select("id", "x", "y")
    if dmin > 0:  # an end isn't its own neighbour then, so ends at one place look once
        near = ends.select("id", "x", "y").join(P.nearest_places(ends, others, dmax, dmax, dmin), ["x", "y"])
    else:
        pairs = P.within(ends.select("id", "x", "y"), others, dmax, dmin).where("id <> to_id")
        near = pairs.groupBy("id").agg(F.min(F.struct("dist", "to_id")).alias("b")).select("id", "b.to_id", "b.dist")
    best = near.select(F.least("id", "to_id").alias("a"), F.greatest("id", "to_id").alias("b"), "dist")
    best = settle(best.groupBy("a", "b").agg(F.min("dist").alias("dist")))
    comp = settle(_components(lines))
    tagged = best.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    apart = tagged.where("ca <> cb").select("a", "b", "dist", F.lit(None).cast("double").alias("loop"), F.lit(None).cast("long").alias("n_between"))
    same = settle(tagged.where("ca = cb"))
    inside = lines.join(comp.select(F.col("node").alias("start_node"), F.col("component").alias("component")), "start_node").join(same.select(F.col("ca").alias("component")), "component", "left_semi")
    loops = same.join(pair_distances(inside, same.select(F.col("ca").alias("component"), "a", "b")), ["a", "b"])
    loops = loops.select("a", "b", "dist", (F.col("way") + F.col("dist")).alias("loop"), (F.col("hops") - 1).cast("long").alias("n_between"))
    width = nodes.select(F.col("id").alias("dangle_node"), F.col("river_width").alias("w1")), nodes.select(F.col("id").alias("inner_node"), F.col("river_width").alias("w2"))
    short = N.dangles(lines).join(width[0], "dangle_node", "left").join(width[1], "inner_node", "left").where(F.col("length") < F.greatest("w1", "w2") * factor)
    short = short.select(F.col("dangle_node").alias("node"), F.lit(True).alias("short"))
    mark = lambda c: short.select(F.col("node").alias(c), F.col("short").alias(f"short_{c}"))
    loops = loops.where((F.col("loop") > min_loop) & (F.col("n_between") > 1)).join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    return apart.unionByName(loops.where("short_a IS NULL OR short_b IS NULL").select("a", "b", "dist", "loop", "n_between"))


def _path_lines(lines: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Ids of the lines on shortest paths from each component's node of greatest drainage area."""
    n = members.join(nodes.select(F.col("id").alias("node"), "darea"), "node", "left").fillna(0.0, ["darea"])
    top = n.groupBy("component").agg(F.max_by("node", F.struct("darea", (-F.col("node")).alias("k"))).alias("node"))
    return shortest_paths(lines, top.select("node")).where("line IS NOT NULL").select(F.col("line").alias("id")).distinct()


def prune_small_components(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids of lines to drop: of two parallel lines that are a component the longer; of a triangle the line between the
    two nodes of least drainage area; of larger components whatever isn't on a shortest path to the node of greatest
    drainage area."""
    comp = settle(_components(lines))
    inside = settle(lines.join(comp.select(F.col("node").alias("start_node"), "component"), "start_node"))
    size = comp.groupBy("component").agg(F.count("*").alias("nn")).join(inside.groupBy("component").agg(F.count("*").alias("nl")), "component")
    two = inside.join(size.where("nn = 2 AND nl = 2"), "component", "left_semi").groupBy("component").agg(F.max_by("id", F.struct("length", (-F.col("id")).alias("k"))).alias("id")).select("id")
    tri = size.where("nn = 3 AND nl = 3").select("component")
    darea = comp.join(tri, "component", "left_semi").join(nodes.select(F.col("id").alias("node"), "darea"), "node")
    low = darea.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy("darea", "node"))).where("r <= 2").select("node")
    between = inside.join(tri, "component", "left_semi").join(low.select(F.col("node").alias("start_node")), "start_node", "left_semi").join(low.select(F.col("node").alias("end_node")), "end_node", "left_semi").select("id")
    rest = size.where("NOT (nn = 2 AND nl = 2) AND NOT (nn = 3 AND nl = 3)").select("component")
    large = inside.join(rest, "component", "left_semi")
    kept = _path_lines(large.drop("component"), nodes, comp.join(rest, "component", "left_semi"))
    return two.unionByName(between).unionByName(large.join(kept, "id", "left_anti").select("id")).distinct()


def remove_cycles(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines without undirected cycles: of what bridges leave over, only shortest paths to the node of greatest
    drainage area stay; the longer of parallel lines and self loops go."""
    left = lines.where("start_node <> end_node")
    left = settle(left.join(N.parallel_lines(left).where("rank > 1").select("id"), "id", "left_anti"))
    while True:  # ends by itself: shortest paths leave no cycle, so every round takes lines
        loops = settle(left.join(bridges(left), "id", "left_anti"))
        if loops.isEmpty():
            break
        gone = loops.join(_path_lines(loops, nodes, _components(loops)), "id", "left_anti").select("id")
        left = settle(left.join(gone, "id", "left_anti"), left)
        release(loops)
    return left


def split_interbasin(lines: DataFrame, cut_nodes: DataFrame) -> DataFrame:
    """``(node, id, n_nodes)``: at each cut node with several lines, the one to drop: that whose far side, without the
    lines of this one cut node, belongs to the component of fewest nodes (-1 where no line is left there), smallest id
    on ties. Cut nodes at an end of a dangle are ignored.

    The network without all cut nodes is taken apart once; each cut node then sees a small graph of those parts and the
    other cut nodes of its component, so the work is the parts times the cut nodes of a component."""
    lines = settle(lines.where("start_node <> end_node").select("id", "start_node", "end_node"))
    degree = N.degrees(lines).select("node", "n_lines")
    tips = degree.where("n_lines = 1").select("node")
    held = N.incidence(lines)
    beside = held.join(held.join(tips, "node", "left_semi").select("line").distinct(), "line", "left_semi").select("node").distinct()
    cuts = settle(cut_nodes.select(F.col("id").alias("node")).distinct().join(degree.where("n_lines > 1"), "node", "left_semi").join(beside, "node", "left_anti"))
    at = settle(N.other_end(cuts.select(F.col("node").alias("id")), lines).select("node", "line", "other"))
    gone = cuts.select(F.col("node").alias("n"))
    rest = lines.join(gone, F.col("start_node") == F.col("n"), "left_anti").join(gone, F.col("end_node") == F.col("n"), "left_anti")
    part = settle(_components(rest))
    # a far node is in a part, is a cut node itself, or stands alone between cut nodes
    far = at.join(part.select(F.col("node").alias("other"), "component"), "other", "left").withColumn("far", F.coalesce("component", "other"))
    sizes = part.groupBy(F.col("component").alias("v")).agg(F.count("*").alias("size"))
    links = settle(far.select(F.col("node").alias("src"), F.col("far").alias("dst")).distinct())
    whole = _components(lines).select("node", F.col("component").alias("whole"))
    tagged = settle(links.join(whole.withColumnRenamed("node", "src"), "src"))
    seen = cuts.join(whole, "node").withColumnRenamed("node", "cut")
    copies = seen.join(tagged, "whole").where("src <> cut AND dst <> cut").select("cut", "src", "dst")
    key = lambda c: F.struct("cut", F.col(c).alias("v"))
    ids = settle(copies.select(key("src").alias("k")).union(copies.select(key("dst").alias("k"))).distinct().withColumn("num", F.monotonically_increasing_id()))
    number = lambda c: ids.select(F.col("k.cut").alias("cut"), F.col("k.v").alias(c), F.col("num").alias(f"{c}_num"))
    joined = copies.join(number("src"), ["cut", "src"]).join(number("dst"), ["cut", "dst"])
    found = connected_components(joined.select(F.col("src_num").alias("src"), F.col("dst_num").alias("dst")))
    member = ids.join(found, F.col("num") == F.col("node")).select("k.cut", "k.v", "component").join(sizes, "v", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    totals = member.groupBy("cut", "component").agg(F.sum("size").alias("n_nodes"))
    known = member.select("cut", "v", "component").join(totals, ["cut", "component"]).select(F.col("cut").alias("node"), F.col("v").alias("far"), "n_nodes")
    each = far.join(known, ["node", "far"], "left").join(sizes.withColumnRenamed("v", "far"), "far", "left")
    each = each.withColumn("n_nodes", F.coalesce("n_nodes", "size", F.lit(-1)))
    best = each.groupBy("node").agg(F.min(F.struct("n_nodes", F.col("line").alias("id"))).alias("b"))
    return best.select("node", "b.id", "b.n_nodes")


def solve_directions(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directions by elevation: lines point down; level ones from the smaller node. A heuristic of our own that leaves
    no directed cycle."""
    e = nodes.select(F.col("id").alias("n"), "elevation")
    a, b = e.select(F.col("n").alias("start_node"), F.col("elevation").alias("ea")), e.select(F.col("n").alias("end_node"), F.col("elevation").alias("eb"))
    up = (F.col("ea") < F.col("eb")) | ((F.col("ea") == F.col("eb")) & (F.col("start_node") > F.col("end_node")))
    wrong = lines.join(a, "start_node").join(b, "end_node").where(up).select("id")
    return N.flip(lines, wrong).select("id", "start_node", "end_node")


def equal_reaches(lines: DataFrame, longest: float) -> DataFrame:
    """Split each line into the fewest equal parts no longer than ``longest``."""
    n = F.greatest(F.ceil(F.col("length") / longest), F.lit(1)).cast("int")
    parts = lines.select("id", "length", n.alias("n"))
    return parts.select("id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("part"), (F.col("length") / F.col("n")).alias("reach_length"))
