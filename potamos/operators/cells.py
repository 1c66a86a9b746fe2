"""Map algebra on cell tables ``(x, y, band, ...)`` keyed by whole-number coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .graph import follow, route
from .lineage import settle

AROUND8 = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
AROUND4 = [(dx, dy) for dx, dy in AROUND8 if dx == 0 or dy == 0]


def cell_id(x: Column | str = "x", y: Column | str = "y") -> Column:
    """One long per cell, reversible while both coordinates fit 32 bits."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.shiftleft(x.cast("long"), 32) + y.cast("long")


def sample(points: DataFrame, cells: DataFrame, bands: list[str], res: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Band values of the cell that each point lies in; an equi-join after snapping to the grid. No cell: null."""
    at = points.withColumns({"__x": F.floor((F.col("x") - x0) / res).cast("long"), "__y": F.floor((F.col("y") - y0) / res).cast("long")})
    return at.join(cells.select(F.col("x").alias("__x"), F.col("y").alias("__y"), *bands), ["__x", "__y"], "left").drop("__x", "__y")


def zonal(cells: DataFrame, zone: list[str], value: str) -> DataFrame:
    """Univariate statistics per zone; null cells are counted apart."""
    v = F.col(value)
    return cells.groupBy(*zone).agg(
        F.count(v).alias("non_null_cells"), F.count_if(v.isNull()).alias("null_cells"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"),
    )


def spread(cells: DataFrame, zone: list[str], **aggregates: Column) -> DataFrame:
    """Zonal aggregates given back to each cell; aggregated before the shuffle, then joined."""
    return cells.join(cells.groupBy(*zone).agg(*(c.alias(n) for n, c in aggregates.items())), zone, "left")


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]], *bands: str) -> DataFrame:
    """``(x, y, dx, dy, bands)``: what each cell hands to the cells around it. Exploding offers and grouping by the
    receiving cell takes one shuffle, where a join per offset would take one each."""
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))).alias("s")
    return cells.select("x", "y", *bands, steps).select((F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), "s.dx", "s.dy", *bands)


def focal(cells: DataFrame, offsets: list[tuple[int, int]] = AROUND8, **aggregates: Column) -> DataFrame:
    """Aggregates over the neighbours of each cell; cells without any get null."""
    bands = [c for c in cells.columns if c not in ("x", "y")]
    found = neighbours(cells, offsets, *bands).groupBy("x", "y").agg(*(c.alias(n) for n, c in aggregates.items()))
    return cells.join(found, ["x", "y"], "left")


def clumps(cells: DataFrame, by: list[str], diagonal: bool = False) -> DataFrame:
    """``clump`` for each cell: the smallest cell id of those connected through equal values of ``by``."""
    offers = neighbours(cells, AROUND8 if diagonal else AROUND4, *by).select("x", "y", "dx", "dy", *(F.col(c).alias(f"n_{c}") for c in by))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"n_{c}"))
    edges = cells.join(offers, ["x", "y"]).where(same).select(cell_id().alias("src"), cell_id(F.col("x") + F.col("dx"), F.col("y") + F.col("dy")).alias("dst"))
    parts = connected_components(edges.where("src < dst"))
    return cells.withColumn("node", cell_id()).join(parts, "node", "left").withColumn("clump", F.coalesce("component", "node")).drop("node", "component")


def fill_small(cells: DataFrame, flag: str, below: int) -> DataFrame:
    """Set the flag on clumps of unflagged cells with fewer than ``below`` cells (bars and islands)."""
    sized = spread(clumps(cells, [flag]), ["clump"], n_cells=F.count("*"))
    return sized.select("x", "y", (F.col(flag) | (F.col("n_cells") < below)).alias(flag))


def patch(*layers: DataFrame, band: str) -> DataFrame:
    """First non-null value of ordered layers, for each cell of any."""
    out = None
    for layer in layers:
        layer = layer.select("x", "y", F.col(band).alias("__b"))
        out = layer.withColumnRenamed("__b", band) if out is None else out.join(layer, ["x", "y"], "full_outer").select("x", "y", F.coalesce(band, "__b").alias(band))
    return out


def resample(cells: DataFrame, factor: int, **aggregates: Column) -> DataFrame:
    """Aggregate to a grid coarser by ``factor``."""
    return cells.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(*(c.alias(n) for n, c in aggregates.items()))


def distance_steps(cells: DataFrame, start: Column, limit: int | None = None) -> DataFrame:
    """``(x, y, steps)``: fewest king moves from the start cells, through cells of the table."""
    grid = settle(cells.select("x", "y"))
    front = settle(cells.where(start).select("x", "y", F.lit(0).alias("steps")))
    found, k = front, 0
    while not front.isEmpty() and (limit is None or k < limit):
        k += 1
        near = neighbours(front, AROUND8).select("x", "y").distinct().join(grid, ["x", "y"], "left_semi")
        front = settle(near.join(found, ["x", "y"], "left_anti").withColumn("steps", F.lit(k)))
        found = found.unionByName(front)
    return found


def steepest(cells: DataFrame, elev: str = "elev") -> DataFrame:
    """``(x, y, to_x, to_y)``: the neighbour with the greatest fall per distance; none lower: null. Ties go to the
    smallest cell."""
    offers = neighbours(cells, AROUND8, elev).withColumnRenamed(elev, "n_elev")
    drop = (F.col(elev) - F.col("n_elev")) / F.when((F.col("dx") != 0) & (F.col("dy") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0)
    near = cells.select("x", "y", elev).join(offers, ["x", "y"]).withColumn("drop", drop).where("drop > 0")
    best = near.groupBy("x", "y").agg(F.min(F.struct((-F.col("drop")).alias("d"), (F.col("x") + F.col("dx")).alias("to_x"), (F.col("y") + F.col("dy")).alias("to_y"))).alias("b"))
    return cells.select("x", "y").join(best.select("x", "y", "b.to_x", "b.to_y"), ["x", "y"], "left")


def accumulate(flow: DataFrame) -> DataFrame:
    """``(x, y, n_cells)``: cells that drain through each cell, itself included. ``flow`` is acyclic. Routing a value of one
    from every cell: runs of cells without a confluence are passed in one step."""
    lines = flow.select(cell_id().alias("id"), cell_id().alias("start_node"), F.when(F.col("to_x").isNotNull(), cell_id("to_x", "to_y")).otherwise(-cell_id() - 1).alias("end_node"), F.lit(1.0).alias("width"))
    _, nodes = route(lines, lines.select(F.col("id").alias("node"), F.lit(1.0).alias("value")))
    at = flow.select("x", "y", cell_id().alias("node"))
    return at.join(nodes, "node").select("x", "y", F.col("node_in").cast("long").alias("n_cells"))


def subbasins(flow: DataFrame, streams: DataFrame) -> DataFrame:
    """``(x, y, to_x, to_y, steps)``: the first stream cell (or sink) that each cell drains to."""
    on = streams.select("x", "y").distinct().withColumn("__s", F.lit(True))
    p = flow.join(on, ["x", "y"], "left").select(cell_id().alias("node"), F.when(F.col("__s").isNull() & F.col("to_x").isNotNull(), cell_id("to_x", "to_y")).alias("next"))
    root = follow(p)
    return root.select(F.shiftright("node", 32).alias("x"), (F.col("node").bitwiseAND(0xFFFFFFFF)).alias("y"), F.shiftright("root", 32).alias("to_x"), F.col("root").bitwiseAND(0xFFFFFFFF).alias("to_y"), "steps")


def fill_depressions(cells: DataFrame, elev: str = "elev") -> DataFrame:
    """``(x, y, elev, filled)``: least water level at which each cell drains to the edge of the table. Levels fall from
    above until none can fall further."""
    table = cells.where(F.col(elev).isNotNull()).select("x", "y", F.col(elev).alias("elev"))
    n = focal(table, AROUND8, n_around=F.count("*"))
    top = F.lit(float("inf"))
    state = settle(n.select("x", "y", "elev", F.when(F.coalesce("n_around", F.lit(0)) < 8, F.col("elev")).otherwise(top).alias("filled")))
    while True:
        low = neighbours(state, AROUND8, "filled").groupBy("x", "y").agg(F.min("filled").alias("low"))
        new = state.join(low, ["x", "y"], "left").withColumn("to", F.least("filled", F.greatest("elev", F.coalesce("low", top))))
        new = settle(new.select("x", "y", "elev", F.col("to").alias("filled"), (F.col("to") < F.col("filled")).alias("fell")))
        state = new.select("x", "y", "elev", "filled")
        if new.where("fell").isEmpty():
            return state


#: Neighbours in the order of the thinning rule, clockwise from north.
RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def thin(cells: DataFrame) -> DataFrame:
    """Skeleton of a set of cells by two-phase parallel thinning (Zhang and Suen)."""
    left = settle(cells.select("x", "y").distinct())
    bit = F.lit(0)
    for k, (dx, dy) in enumerate(RING):
        bit = F.when((F.col("dx") == dx) & (F.col("dy") == dy), 1 << k).otherwise(bit)
    p = [F.shiftright("ring", k).bitwiseAND(1) for k in range(8)]
    count = sum(p[1:], p[0])
    turns = sum((((p[k] == 0) & (p[(k + 1) % 8] == 1)).cast("int") for k in range(1, 8)), ((p[0] == 0) & (p[1] == 1)).cast("int"))
    while True:
        before = left.count()
        for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            ring = neighbours(left, AROUND8).groupBy("x", "y").agg(F.sum(bit).cast("int").alias("ring"))
            at = left.join(ring, ["x", "y"], "left").fillna(0, ["ring"])
            gone = (count >= 2) & (count <= 6) & (turns == 1) & (p[first[0]] * p[first[1]] * p[first[2]] == 0) & (p[second[0]] * p[second[1]] * p[second[2]] == 0)
            left = settle(at.where(~gone).select("x", "y"))
        if left.count() == before:
            return left


def to_lines(cells: DataFrame) -> DataFrame:
    """Lines between neighbouring cells of a skeleton: ``(start_node, end_node)`` by cell id, each pair once."""
    offers = neighbours(cells.select("x", "y"), AROUND8)
    pairs = cells.select("x", "y").join(offers, ["x", "y"]).select(cell_id().alias("start_node"), cell_id(F.col("x") + F.col("dx"), F.col("y") + F.col("dy")).alias("end_node"))
    return pairs.where("start_node < end_node")
