"""Iterative graph operators. Every loop keeps its state in tables, settles it once a round and never collects it;
a round costs a constant number of joins on what is still active."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .lineage import Rounds, release, settle


def _none(df: DataFrame) -> bool:
    return df.isEmpty()


def chains(lines: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``chain`` and ``pos``: runs of lines joined by nodes of one inflow and one outflow, named by their
    first line and numbered from 0. Runs that close on themselves have no chain. Pointer jumping: a number of rounds
    that grows with the logarithm of the longest run. Self loops must be gone; no run goes over a node of ``stops``."""
    ends = lines.select(F.col("start_node").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(lines.select("end_node", F.lit(0), F.lit(1)))
    inner = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 AND i = 1").select("node")
    inner = inner if stops is None else inner.join(stops, "node", "left_anti")
    above = lines.select(F.col("end_node").alias("node"), F.col("id").alias("above")).join(inner, "node").select(F.col("node").alias("start_node"), "above")
    before = lines.select("id", "start_node").join(above, "start_node", "left").select(F.col("id").alias("node"), F.col("above").alias("next"))
    heads = follow(before).select(F.col("node").alias("id"), F.col("root").alias("chain"), F.col("steps").alias("pos"))
    return lines.join(heads, "id", "left")


def _sweep(edges: DataFrame, combine, head: Column, gain: Column) -> DataFrame:
    """``(chain, head)``: a value for the start of each edge once all edges above are done, which adds ``gain`` on its way
    down; ``combine`` joins what arrives at a node and ``head`` makes the start value from it (``came``). Only the
    front and nodes that still wait for an inflow are held; edges on and below cycles get no row."""
    n_in = edges.groupBy(F.col("end_node").alias("node")).agg(F.count("*").alias("n_in"))
    edges = settle(edges.join(n_in.withColumnRenamed("node", "end_node"), "end_node"))
    log, pool = Rounds(edges.sparkSession), None
    columns = ["chain", "end_node", "n_in", head.cast("double").alias("head"), (head + gain).cast("double").alias("carry")]
    sources = edges.join(edges.select(F.col("end_node").alias("start_node")), "start_node", "left_anti")
    front = log.add(sources.withColumn("came", F.lit(0.0)).select(*columns))
    while not _none(front):
        arrived = front.select(F.col("end_node").alias("node"), "n_in", "carry", F.lit(1).alias("n"))
        held = arrived if pool is None else pool.where("n < n_in").unionByName(arrived)
        pool = settle(held.groupBy("node", "n_in").agg(combine("carry").alias("carry"), F.sum("n").cast("int").alias("n")), pool)
        ready = pool.where("n = n_in").select(F.col("node").alias("start_node"), F.col("carry").alias("came"))
        front = log.add(edges.join(ready, "start_node").select(*columns))
    release(edges, pool)
    return log.all().select("chain", "head")


def levels(lines: DataFrame) -> DataFrame:
    """``(id, level)``: 1 for lines from inlets, else one more than the highest level above; -1 on and below directed
    cycles, and for self loops. Chains are passed in one step, so the rounds are as many as junctions on the longest way."""
    table = settle(chains(lines.where("start_node <> end_node").select("id", "start_node", "end_node")))
    edges = table.where("chain IS NOT NULL").groupBy("chain").agg(F.min_by("start_node", "pos").alias("start_node"), F.max_by("end_node", "pos").alias("end_node"), F.count("*").alias("k"))
    found = _sweep(edges, F.max, F.col("came") + 1, F.col("k") - 1)
    level = table.join(found, "chain").select("id", (F.col("head") + F.col("pos")).cast("int").alias("level"))
    return lines.select("id").join(level, "id", "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def route(lines: DataFrame, node_values: DataFrame, line_values: DataFrame | None = None, method: str = "sum") -> tuple[DataFrame, DataFrame]:
    """Route values downstream. ``node_values`` is ``(node, value)``, ``line_values`` ``(id, value)``; missing and null
    values are 0. A node holds what flows in and its own value, unless no line leaves it; that goes to its lines by
    their share of the width, or all to the main branch (``method='mainstem'``); a line adds its own value on the way.

    Returns ``(id, line_in, line_out)`` for all lines and ``(node, node_in, node_out)`` for all nodes, ``node_out`` being what
    goes into each line by ascending id. Lines on and below directed cycles, and self loops, come first in the order of
    routing, so they carry their node's own value and nothing from above; what a self loop carries is back at its node
    when the node's other lines are routed. Lines may share an id: each row is a line of its own, and ``line_values`` holds
    for all rows of an id (the greatest, where an id has several)."""
    w = Window.partitionBy("start_node")
    share = F.col("width") / F.sum("width").over(w)
    if method == "mainstem":
        share = (F.row_number().over(w.orderBy(F.desc("width"), "id")) == 1).cast("double")
    own = node_values.groupBy(F.col("node").alias("start_node")).agg(F.max(F.coalesce("value", F.lit(0.0))).alias("own"))
    table = lines.select("id", "start_node", "end_node", share.alias("share")).join(own, "start_node", "left")
    if line_values is not None:
        table = table.join(line_values.groupBy("id").agg(F.max("value").alias("line_value")), "id", "left")
    else:
        table = table.withColumn("line_value", F.lit(0.0))
    numbered = table = settle(table.fillna(0.0, ["own", "line_value"]).withColumn("row", F.monotonically_increasing_id()))
    loops = table.where("start_node = end_node").groupBy("start_node").agg(F.sum(F.col("share") * F.col("own") + F.col("line_value")).alias("looped"))
    loops = settle(loops)
    runs = chains(table.where("start_node <> end_node").select(F.col("row").alias("id"), "start_node", "end_node"), loops.select(F.col("start_node").alias("node"))).select(F.col("id").alias("row"), "chain", "pos")
    table = settle(table.join(runs, "row", "left").join(loops, "start_node", "left").fillna(0.0, ["looped"]), numbered)
    # inside a chain all of a node goes on: its own value joins what the line above brings
    inner = F.when(F.col("pos") > 0, F.col("own")).otherwise(0.0)
    first = lambda c: F.min_by(c, "pos").alias(c)
    edges = table.where("chain IS NOT NULL").groupBy("chain").agg(first("start_node"), first("share"), first("own"), first("looped"), F.max_by("end_node", "pos").alias("end_node"), (F.sum("line_value") + F.sum(inner)).alias("gain"))
    found = _sweep(edges, F.sum, F.col("share") * (F.col("came") + F.col("own") + F.col("looped")), F.col("gain"))
    along = Window.partitionBy("chain").orderBy("pos")
    passed = F.sum(inner).over(along) + F.coalesce(F.sum("line_value").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    flow = table.where("chain IS NOT NULL").withColumn("passed", passed).join(found, "chain", "left").select("row", (F.col("head") + F.col("passed")).alias("flow"))
    done = table.join(flow, "row", "left").withColumn("line_in", F.coalesce("flow", F.col("share") * F.col("own"), F.lit(0.0)))
    done = settle(done.select("id", "start_node", "end_node", "own", "line_in", (F.col("line_in") + F.col("line_value")).alias("line_out")), table)
    out = done.groupBy(F.col("start_node").alias("node")).agg(F.max("own").alias("own"), F.sort_array(F.collect_list(F.struct("id", "line_in"))).getField("line_in").alias("node_out"))
    came = done.groupBy(F.col("end_node").alias("node")).agg(F.sum("line_out").alias("came"))
    nodes = out.join(came, "node", "full_outer")
    node_in = F.coalesce("came", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))
    return done.select("id", "line_in", "line_out"), nodes.select("node", node_in.alias("node_in"), F.coalesce("node_out", F.expr("cast(array() as array<double>)")).alias("node_out"))


def route_cells(lines: DataFrame, node_values: DataFrame, vertices: DataFrame, method: str = "sum") -> DataFrame:
    """``(id, pos, routed)``: what flows through each cell of a line, its own value included. ``vertices`` is
    ``(id, pos, value)``; null values are 0."""
    value = F.coalesce("value", F.lit(0.0))
    routed, _ = route(lines, node_values, vertices.groupBy("id").agg(F.sum(value).alias("value")), method)
    along = Window.partitionBy("id").orderBy("pos")
    return vertices.join(routed, "id").select("id", "pos", (F.col("line_in") + F.sum(value).over(along)).alias("routed"))


def route_mean(lines: DataFrame, node_values: DataFrame, vertices: DataFrame, node_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means instead of sums: what is routed, over the number of cells that drain there. ``vertices`` is
    ``(id, pos, value, n_cells)`` and ``node_cells`` ``(node, n_cells)``. Returns ``(id, pos, mean)`` and
    ``(node, mean_in, mean_out)``, the latter over all lines that leave the node."""
    value = F.coalesce("value", F.lit(0.0))
    routed, nodes = route(lines, node_values, vertices.groupBy("id").agg(F.sum(value).alias("value")))
    along = Window.partitionBy("id").orderBy("pos")
    cells = vertices.join(routed, "id").select("id", "pos", ((F.col("line_in") + F.sum(value).over(along)) / F.col("n_cells")).alias("mean"))
    out = F.aggregate("node_out", F.lit(0.0), lambda a, b: a + b)
    return cells, nodes.join(node_cells, "node").select("node", (F.col("node_in") / F.col("n_cells")).alias("mean_in"), (out / F.col("n_cells")).alias("mean_out"))


def reachable(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, hops)``: nodes downstream of the seed nodes with the fewest steps."""
    edges = settle(lines.select("start_node", "end_node").distinct())
    log, hops = Rounds(edges.sparkSession), 0
    front = log.add(seeds.select(F.col("node")).distinct().withColumn("hops", F.lit(0)))
    while not _none(front):  # ends by itself: each round finds new nodes
        hops += 1
        nxt = front.join(edges, F.col("node") == F.col("start_node")).select(F.col("end_node").alias("node")).distinct()
        front = log.add(nxt.join(log.all().select("node"), "node", "left_anti").withColumn("hops", F.lit(hops)))
    release(edges)
    return log.all().select("node", "hops")


def downstream_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept lines and all lines reachable from their ends."""
    below = reachable(lines, lines.join(kept, "id", "left_semi").select(F.col("end_node").alias("node")))
    return lines.join(below.select(F.col("node").alias("start_node")), "start_node", "left_semi").unionByName(lines.join(kept, "id", "left_semi")).dropDuplicates(["id"])


def shortest_paths(lines: DataFrame, sources: DataFrame, weight: str = "length", directed: bool = False) -> DataFrame:
    """``(source, node, distance, line)``: least cost from each source and the line that arrives (smallest id on ties).
    Bellman-Ford on the active front: a round only moves nodes whose distance has just fallen."""
    edges = lines.select("start_node", "end_node", "id", F.col(weight).alias("cost"))
    if not directed:
        edges = edges.unionByName(edges.select(F.col("end_node").alias("start_node"), F.col("start_node").alias("end_node"), "id", "cost"))
    edges = settle(edges)
    best = settle(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("line")).distinct())
    front = best
    while True:  # ends by itself: distances only fall
        step = front.join(edges, F.col("node") == F.col("start_node")).select("source", F.col("end_node").alias("node"), (F.col("distance") + F.col("cost")).alias("distance"), F.col("id").alias("line"))
        step = step.groupBy("source", "node").agg(F.min(F.struct("distance", "line")).alias("new")).select("source", "node", "new.*")
        old = best.select("source", "node", F.struct("distance", "line").alias("old"))
        better = step.join(old, ["source", "node"], "left").where("old IS NULL OR distance < old.distance").drop("old")
        front = settle(better, front if front is not best else None)
        if _none(front):
            release(edges, front)
            return best
        best = settle(best.join(front, ["source", "node"], "left_anti").unionByName(front), best)


def pair_distances(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, way, hops)``: the least length and the fewest lines between the nodes of each pair, directions ignored.
    ``lines`` is ``(component, start_node, end_node, length)``, ``pairs`` ``(component, a, b)``.

    Nodes are taken out one by one, those of fewest neighbours first, and their neighbours linked by the ways over them;
    a shortest way then climbs from both ends to a common node. One task per component; what a node sees above it
    is little in networks that are nearly trees, however large, and grows with their width in dense meshes."""
    rows = lines.select("component", F.col("start_node").alias("a"), F.col("end_node").alias("b"), F.col("length").cast("double").alias("way"), F.lit(False).alias("pair"))
    rows = rows.unionByName(pairs.select("component", "a", "b", F.lit(0.0).alias("way"), F.lit(True).alias("pair")))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, tuple[float, int]]] = {}

        def link(a: int, b: int, way: float, hops: int) -> None:
            for p, q in ((a, b), (b, a)):
                old = near.setdefault(p, {}).get(q)
                near[p][q] = (way, hops) if old is None else (min(old[0], way), min(old[1], hops))

        wanted = pdf[pdf.pair]
        held = pdf[~pdf.pair]
        for a, b, way in zip(held.a.tolist(), held.b.tolist(), held.way.tolist()):
            link(a, b, way, 1)
        rank: dict[int, int] = {}
        above: dict[int, dict[int, tuple[float, int]]] = {}
        queue = [(len(v), k) for k, v in near.items()]
        heapq.heapify(queue)
        while queue:
            n, node = heapq.heappop(queue)
            if node in rank or n != len(near[node]):
                continue
            rank[node] = len(rank)
            around = above[node] = near.pop(node)
            for p in around:
                del near[p][node]
            ends = list(around.items())
            for i, (p, (w1, h1)) in enumerate(ends):
                for q, (w2, h2) in ends[:i]:
                    link(p, q, w1 + w2, h1 + h2)
            for p in around:
                heapq.heappush(queue, (len(near[p]), p))

        def climb(start: int) -> dict[int, tuple[float, int]]:
            seen, open_ = {start: (0.0, 0)}, [(rank[start], start)]
            while open_:
                _, node = heapq.heappop(open_)
                w0, h0 = seen[node]
                for p, (w, h) in above[node].items():
                    old = seen.get(p)
                    if old is None:
                        heapq.heappush(open_, (rank[p], p))
                        seen[p] = (w0 + w, h0 + h)
                    else:
                        seen[p] = (min(old[0], w0 + w), min(old[1], h0 + h))
            return seen

        out = []
        for a, b in zip(wanted.a.tolist(), wanted.b.tolist()):
            up, down = climb(a), climb(b)
            both = [(up[k], down[k]) for k in up if k in down]
            out.append((a, b, min(x[0] + y[0] for x, y in both), min(x[1] + y[1] for x, y in both)))
        return pd.DataFrame(out, columns=["a", "b", "way", "hops"]).astype({"a": "int64", "b": "int64", "way": "float64", "hops": "int64"})

    return rows.groupBy("component").applyInPandas(find, "a long, b long, way double, hops long")


def bridges(lines: DataFrame) -> DataFrame:
    """Ids of lines whose removal parts their component. One task per component; a task holds one component."""
    members = connected_components(lines.select(F.col("start_node").alias("src"), F.col("end_node").alias("dst")))
    tagged = lines.select("id", "start_node", "end_node").join(members.select(F.col("node").alias("start_node"), "component"), "start_node")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(pdf.id, pdf.start_node, pdf.end_node):
            around.setdefault(a, []).append((b, i))
            around.setdefault(b, []).append((a, i))
        seen: dict[int, int] = {}
        low: dict[int, int] = {}
        out = []
        for root in around:
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack: list[tuple[int, int, Iterator]] = [(root, -1, iter(around[root]))]
            while stack:
                node, via, rest = stack[-1]
                for other, line in rest:
                    if line == via:
                        continue
                    if other in seen:
                        low[node] = min(low[node], seen[other])
                    else:
                        seen[other] = low[other] = len(seen)
                        stack.append((other, line, iter(around[other])))
                        break
                else:
                    stack.pop()
                    if stack:
                        above = stack[-1][0]
                        low[above] = min(low[above], low[node])
                        if low[node] > seen[above]:
                            out.append(via)
        return pd.DataFrame({"id": pd.Series(out, dtype="int64")})

    return tagged.groupBy("component").applyInPandas(find, "id long")


def strong_components(lines: DataFrame) -> DataFrame:
    """``(node, scc)`` for nodes on directed cycles, scc being the smallest node id of the strong component.

    Ends that can't be on a cycle are trimmed first. Then every node takes the smallest id that reaches it; the nodes
    of that label which reach its owner are one strong component, and what is left goes round again."""
    left = settle(lines.select("start_node", "end_node").distinct())
    loops = left.where("start_node = end_node").select(F.col("start_node").alias("node"), F.col("start_node").alias("scc"))
    left = left.where("start_node <> end_node")
    found = loops.limit(0)
    while True:
        while True:
            kept = left.join(left.select(F.col("end_node").alias("start_node")), "start_node", "left_semi")
            kept = settle(kept.join(kept.select(F.col("start_node").alias("end_node")), "end_node", "left_semi").select("start_node", "end_node"))
            if kept.count() == left.count():
                break
            left = kept
        left = kept
        if _none(left):
            break
        label = settle(left.select(F.col("start_node").alias("node")).union(left.select("end_node")).distinct().withColumn("label", F.col("node")))
        while True:
            came = left.join(label.select(F.col("node").alias("start_node"), "label"), "start_node").groupBy(F.col("end_node").alias("node")).agg(F.min("label").alias("came"))
            new = settle(label.join(came, "node", "left").select("node", F.least("label", "came").alias("label"), (F.col("came") < F.col("label")).alias("moved")))
            label = new.select("node", "label")
            if _none(new.where("moved")):
                break
        inside = left.join(label.select(F.col("node").alias("start_node"), F.col("label").alias("l1")), "start_node").join(label.select(F.col("node").alias("end_node"), F.col("label").alias("l2")), "end_node").where("l1 = l2")
        inside = settle(inside.select(F.col("end_node").alias("start_node"), F.col("start_node").alias("end_node")))
        owners = label.where("node = label").select("node")
        back = reachable(inside, owners).select("node")
        scc = settle(back.join(label, "node").withColumnRenamed("label", "scc"))
        sizes = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(scc.join(sizes, "scc", "left_semi").select("node", "scc"))
        gone = scc.select("node")
        left = settle(left.join(gone.select(F.col("node").alias("start_node")), "start_node", "left_anti").join(gone.select(F.col("node").alias("end_node")), "end_node", "left_anti").select("start_node", "end_node"))
    return found.unionByName(loops).groupBy("node").agg(F.min("scc").alias("scc"))


def cycle_report(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with undefined ends go, then lines on directed cycles are found: ``(id, cycle)`` with the smallest node
    of the cluster, and per cluster its nodes, in- and outflow nodes (nodes outside that touch it by one line only) and
    label: a source has outflows only, a sink inflows only."""
    clean = lines.where("start_node >= 0 AND end_node >= 0")
    scc = settle(strong_components(clean))
    s, e = scc.select(F.col("node").alias("start_node"), F.col("scc").alias("s1")), scc.select(F.col("node").alias("end_node"), F.col("scc").alias("s2"))
    induced = clean.join(s, "start_node").join(e, "end_node")
    clusters = connected_components(induced.select(F.col("start_node").alias("src"), F.col("end_node").alias("dst")))
    on = induced.where("s1 = s2").join(clusters.select(F.col("node").alias("start_node"), F.col("component").alias("cycle")), "start_node")
    flagged = settle(on.select("id", "cycle"))
    # nodes that touch a cluster from outside by exactly one line, which leads in or out of it
    within = lambda c, name: clusters.select(F.col("node").alias(c), F.col("component").alias(name))
    touching = clean.join(within("start_node", "c1"), "start_node", "left").join(within("end_node", "c2"), "end_node", "left")
    outward = touching.where("c1 IS NOT NULL AND c1 IS DISTINCT FROM c2").select(F.col("c1").alias("cycle"), F.col("end_node").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    inward = touching.where("c2 IS NOT NULL AND c1 IS DISTINCT FROM c2").select(F.col("c2").alias("cycle"), F.col("start_node").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    beside = outward.union(inward).groupBy("cycle", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i + o = 1")
    flows = beside.groupBy("cycle").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    size = clusters.groupBy(F.col("component").alias("cycle")).agg(F.count("*").alias("n_nodes"))
    report = size.join(flows, "cycle", "left").fillna(0, ["n_in", "n_out"])
    label = F.when((F.col("n_out") > 0) & (F.col("n_in") == 0), "single-source").when((F.col("n_in") > 0) & (F.col("n_out") == 0), "single-sink").otherwise("in-out")
    return flagged, report.withColumn("label", label)


def continuity_violations(lines: DataFrame, outlets: DataFrame) -> DataFrame:
    """Nodes other than outlets where water appears from or vanishes into nothing at more than one line."""
    n = lines.where("start_node <> end_node")
    ends = n.select(F.col("start_node").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(n.select("end_node", F.lit(0), F.lit(1)))
    d = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return d.where("(n_in = 0 AND n_out > 1) OR (n_in > 1 AND n_out = 0)").join(outlets, "node", "left_anti")


def upstream_bifurcations(lines: DataFrame) -> DataFrame:
    """``(id, n_bifurcations)``: distinct bifurcating nodes at and above the start of each line. The table of
    (bifurcation, node below) pairs is kept distinct every round."""
    edges = settle(lines.select("start_node", "end_node").distinct())
    forks = lines.groupBy("start_node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("start_node").alias("fork"))
    front = settle(forks.select("fork", F.col("fork").alias("node")))
    pairs = front
    while not _none(front):
        nxt = front.join(edges, F.col("node") == F.col("start_node")).select("fork", F.col("end_node").alias("node")).distinct()
        front = settle(nxt.join(pairs, ["fork", "node"], "left_anti"))
        pairs = settle(pairs.unionByName(front))
    counts = pairs.groupBy(F.col("node").alias("start_node")).agg(F.count("*").alias("n_bifurcations"))
    return lines.select("id", "start_node").join(counts, "start_node", "left").select("id", F.coalesce("n_bifurcations", F.lit(0)).alias("n_bifurcations"))


def peel_leaves(lines: DataFrame, may_go: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """``(id, round, reversed)``: dangling lines peeled off while their free end and the other end are in ``may_go``
    (nodes), and whether the line pointed towards the leaf. Free ends must be among ``tips`` too, where these are given."""
    tips = may_go if tips is None else tips
    left, log, rnd = settle(lines.select("id", "start_node", "end_node")), Rounds(lines.sparkSession), 0
    ok = may_go.select("node").distinct().withColumn("ok", F.lit(True))
    while True:  # ends by itself: each round takes lines away
        rnd += 1
        ends = left.select(F.col("start_node").alias("node")).union(left.select("end_node"))
        leaf = ends.groupBy("node").agg(F.count("*").alias("n")).where("n = 1").join(tips, "node", "left_semi").select("node", F.lit(True).alias("leaf"))
        at = left.join(leaf.select(F.col("node").alias("start_node"), F.col("leaf").alias("l1")), "start_node", "left").join(leaf.select(F.col("node").alias("end_node"), F.col("leaf").alias("l2")), "end_node", "left")
        at = at.join(ok.select(F.col("node").alias("start_node"), F.col("ok").alias("o1")), "start_node", "left").join(ok.select(F.col("node").alias("end_node"), F.col("ok").alias("o2")), "end_node", "left")
        gone = log.add(at.where("(l1 AND o2) OR (l2 AND o1)").select("id", F.lit(rnd).alias("peeled"), F.coalesce(~F.col("l1"), F.lit(True)).alias("reversed")))
        if _none(gone):
            release(left)
            return log.all().select("id", F.col("peeled").alias("round"), "reversed")
        left = settle(left.join(gone, "id", "left_anti"), left)


def merge_polylines(lines: DataFrame) -> DataFrame:
    """``(id, segment)``: lines that meet at nodes of degree 2 become one segment, named by its smallest line."""
    ends = lines.select("id", F.col("start_node").alias("node")).union(lines.select("id", F.col("end_node")))
    meet = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("src"), F.max("id").alias("dst")).where("n = 2 AND src <> dst")
    parts = connected_components(meet)
    return lines.select("id").join(parts.select(F.col("node").alias("id"), F.col("component").alias("segment")), "id", "left").withColumn("segment", F.coalesce("segment", "id"))


def follow(pointers: DataFrame) -> DataFrame:
    """``(node, root, steps)``: the end of each chain of ``(node, next)``; a node that points nowhere, or at itself,
    is a root. Pointer jumping: log2 of the longest chain rounds. Chains that close on themselves are left out."""
    known = pointers.select(F.col("node").alias("k"))
    state = pointers.join(known, F.col("next") == F.col("k"), "left")
    state = settle(state.select("node", F.coalesce("k", "next", "node").alias("to"), F.when(F.coalesce("next", "node") == F.col("node"), 0).otherwise(1).cast("long").alias("steps")))
    for _ in range(state.count().bit_length() + 1):
        nxt = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        new = settle(state.join(nxt, "to", "left").select("node", F.coalesce("to2", "to").alias("new"), "to", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        open_ = new.where("new <> to")
        state = new.select("node", F.col("new").alias("to"), "steps")
        if _none(open_):
            break
    roots = state.where("node = to AND steps = 0").select(F.col("node").alias("to"))
    outside = state.join(known, F.col("to") == F.col("k"), "left_anti").select("to").distinct()
    return state.join(roots.union(outside).distinct(), "to", "left_semi").select("node", F.col("to").alias("root"), "steps")
