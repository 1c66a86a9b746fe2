"""Raster stages composed of map algebra: masks, coasts, lakes, conditioning, sinks, solver bands, catchments.

Cells are ``(x, y, band, ...)`` by whole-number coordinates; ``res`` is the side of a cell in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from . import spatial as P
from .components import connected_components
from .lineage import settle
from .stats import running_total


def grow(cells: DataFrame, seeds: DataFrame, start: float = 8.0) -> DataFrame:
    """``(x, y, sx, sy, dist)``: the nearest seed cell of each cell, straight, in cells; smallest cell id on ties. Only
    seeds with a neighbour that is no seed can be nearest to another cell, so seeds inside an area are left out."""
    held = seeds.select("x", "y").distinct().withColumn("seed", F.lit(True))
    around = C.neighbours(held, C.AROUND4).groupBy("x", "y").agg(F.count("*").alias("k"))
    rim = held.join(around, ["x", "y"], "left").where("coalesce(k, 0) < 4").select(C.cell_id().alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rest = cells.select("x", "y").join(held, ["x", "y"], "left_anti").select(C.cell_id().alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = P.nearest(rest, settle(rim), start)
    at = lambda c, name: (F.shiftright(c, 32).alias(f"{name}x"), F.col(c).bitwiseAND(0xFFFFFFFF).alias(f"{name}y"))
    far = near.select(*at("id", ""), *at("to_id", "s"), "dist")
    own = cells.select("x", "y").join(held, ["x", "y"], "left_semi").select("x", "y", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(0.0).alias("dist"))
    return far.unionByName(own)


def grown_value(cells: DataFrame, band: str, name: str) -> DataFrame:
    """``cells`` with the band of the nearest cell that has one."""
    held = settle(cells.where(F.col(band).isNotNull()).select("x", "y", band))
    value = held.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(band).alias(name))
    return cells.join(grow(cells, held).join(value, ["sx", "sy"]).select("x", "y", name), ["x", "y"], "left")


def fill_river_mask(cells: DataFrame, cell_km2: float, bar_km2: float = 1.0, lake_island_km2: float = 50.0, lake: int = 180) -> DataFrame:
    """``(x, y, grwl)`` of the filled mask. ``cells`` is ``(x, y, grwl)``, null off the water. Gaps below ``bar_km2`` are
    bars and filled, as are islands below ``lake_island_km2`` whose nearest water is lake throughout; a filled cell takes
    the class of the nearest water."""
    full = settle(grown_value(cells, "grwl", "near").withColumn("wet", F.col("grwl").isNotNull()))
    sized = C.spread(C.clumps(full.select("x", "y", "wet", "near"), ["wet"]), ["clump"], km2=F.count("*") * F.lit(cell_km2), mean=F.avg("near"))
    kept = F.col("wet") | ((F.col("mean") == lake) & (F.col("km2") < lake_island_km2)) | (F.col("km2") < bar_km2)
    return sized.where(kept).select("x", "y", F.col("near").cast("int").alias("grwl"))


def extend_coast(cells: DataFrame, res: float, reach: float = 60_000.0, factor: float = 3.0, lake: int = 180) -> DataFrame:
    """``(x, y, grwl)`` with rivers led on into the sea. ``cells`` is ``(x, y, grwl, land, coast_dist)``; water on land
    nearer to the coast than ``reach`` forms clumps by class; a sea cell takes the class of the clump nearest to it if
    the coast is nearer than ``factor`` times twice the clump's greatest bank distance."""
    wet = settle(cells.where((F.col("land")) & (F.col("coast_dist") < reach) & F.col("grwl").isNotNull() & (F.col("grwl") != lake)).select("x", "y", "grwl"))
    clumped = settle(C.clumps(wet, ["grwl"]))
    dry = cells.select("x", "y").join(wet, ["x", "y"], "left_anti")
    bank = grow(cells, dry).where("dist > 0").select("x", "y", (F.col("dist") * res).alias("bank"))
    widest = clumped.join(bank, ["x", "y"]).groupBy("clump", "grwl").agg(F.max("bank").alias("widest"))
    land = settle(cells.where("land").select("x", "y").join(clumped.select("x", "y", "clump"), ["x", "y"], "left"))
    sea = cells.where("NOT land").select("x", "y", "coast_dist")
    near = grow(cells.select("x", "y"), land.select("x", "y")).where("dist > 0")
    near = near.join(land.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "clump"), ["sx", "sy"]).where("clump IS NOT NULL")
    led = sea.join(near.select("x", "y", "clump"), ["x", "y"]).join(widest, "clump").where(F.col("coast_dist") < F.col("widest") * factor * 2).select("x", "y", F.col("grwl").alias("led"))
    joined = cells.join(led, ["x", "y"], "left")
    return joined.select("x", "y", F.when(F.col("land"), F.col("grwl")).otherwise(F.col("led")).cast("int").alias("grwl")).where("grwl IS NOT NULL")


def patch_lake_gaps(cells: DataFrame, lakes: DataFrame, tile: int, shrink: float, gap: float, min_area: float, size: float, lake: int = 180) -> DataFrame:
    """``(x, y, grwl)`` with the gaps closed that tile borders leave in large lakes. ``lakes`` is ``(id, minx, miny, maxx,
    maxy, area)``, boxes that stand for shapes; cells within ``gap`` of a tile border inside a large lake shrunk by
    ``shrink`` are lake."""
    large = lakes.where(F.col("area") > min_area).select("id", (F.col("minx") + shrink).alias("minx"), (F.col("miny") + shrink).alias("miny"), (F.col("maxx") - shrink).alias("maxx"), (F.col("maxy") - shrink).alias("maxy")).where("minx < maxx AND miny < maxy")
    off = lambda c: F.least(F.pmod(F.col(c), F.lit(tile)), tile - F.pmod(F.col(c), F.lit(tile)))
    rim = cells.where((off("x") <= gap) | (off("y") <= gap)).select(C.cell_id().alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    inside = P.boxes_holding(rim, large, size).select("id").distinct().select(F.shiftright("id", 32).alias("x"), F.col("id").bitwiseAND(0xFFFFFFFF).alias("y"), F.lit(lake).alias("gap"))
    return cells.join(inside, ["x", "y"], "left").select("x", "y", F.coalesce("gap", "grwl").alias("grwl"))


def dem_lowering(cells: DataFrame, res: float, accuracy: float = 15.0, buffer: float = 500.0, lake: int = 180) -> DataFrame:
    """``(x, y, lowering)``: how far elevation goes down so that flow keeps to rivers. ``cells`` is ``(x, y, halfwidth,
    grwl, centre, osm, osm_small, end_dist)``: half widths in metres (null off rivers), whether a centre line, a large or
    a small mapped line crosses the cell, and the distance to the next line end (null beyond ``buffer``)."""
    steps = F.col("halfwidth") / res
    bank = F.coalesce(F.when(F.col("grwl") == lake, F.log(steps)).otherwise(steps), F.lit(0.0))
    centre = F.when(F.col("centre"), F.coalesce(F.col("halfwidth") / (2 * res) + 5, F.lit(0.0))).otherwise(0.0)
    dry = F.col("halfwidth").isNull()
    osm = F.when(dry & F.col("osm"), 2.0).otherwise(0.0) + F.when(dry & F.col("osm_small"), 1.0).otherwise(0.0)
    ends = F.coalesce((buffer - F.col("end_dist")) / buffer, F.lit(0.0)) * 3
    return cells.select("x", "y", ((bank + centre + osm + ends) * accuracy).alias("lowering"))


def sinks(cells: DataFrame, cell_km2: float, min_fill: float = 10.0, min_km3: float = 20.0) -> DataFrame:
    """``(x, y, sink, volume, depth)``. ``cells`` is ``(x, y, elev, river, lake, closed)``: whether a river crosses the cell, the
    id of its lake or null, and whether that lake is known to be closed.

    Rivers and the cells around them are burnt to 0 before depressions are filled. Cells filled by more than
    ``min_fill`` metres against the elevation as it was form depressions; where one holds more than ``min_km3``, its
    lowest cells (up to the second percentile of elevation) are a sink named by the depression. A lake that holds
    such a cell is a sink as a whole, as is a closed one; both are named 1."""
    near = C.neighbours(cells.where("river").select("x", "y"), C.AROUND8).select("x", "y").union(cells.where("river").select("x", "y")).distinct().withColumn("burnt", F.lit(True))
    burnt = cells.join(near, ["x", "y"], "left").withColumn("low", F.when(F.col("burnt"), 0.0).otherwise(F.col("elev")))
    filled = C.fill_depressions(burnt.select("x", "y", F.col("low").alias("elev"))).select("x", "y", "filled")
    deep = settle(cells.join(filled, ["x", "y"]).withColumn("depth", F.col("filled") - F.col("elev")).where(F.col("depth") > min_fill).select("x", "y", "elev", "depth", F.lit(1).alias("one")))
    ids = C.clumps(deep, ["one"], diagonal=True)
    facts = C.spread(ids, ["clump"], total=F.sum("depth"), floor=F.percentile("elev", F.lit(0.02))).withColumn("volume", F.col("total") * cell_km2 / 1000)
    low = settle(facts.where((F.col("volume") > min_km3) & (F.col("elev") <= F.col("floor"))).select("x", "y", F.col("clump").alias("sink"), "volume", "depth"))
    wet = cells.where("lake IS NOT NULL").select("x", "y", "lake", "closed")
    holding = wet.join(low.select("x", "y"), ["x", "y"], "left_semi").select("lake").distinct().withColumn("holds", F.lit(True))
    whole = wet.join(holding, "lake", "left").where("holds OR closed").select("x", "y", F.lit(1).cast("long").alias("lake_sink"))
    return low.join(whole, ["x", "y"], "full_outer").select("x", "y", F.coalesce("lake_sink", "sink").alias("sink"), "volume", "depth")


def class_change_nodes(vertices: DataFrame, apart: float) -> DataFrame:
    """``(id, pos, x, y)``: places along lines where the class changes. ``vertices`` is ``(id, pos, x, y, class)``. Of changes that
    are joined by steps of at most ``apart`` the first stays (smallest line, then place), none if an end of a line is
    among them."""
    w = Window.partitionBy("id")
    v = vertices.withColumns({"before": F.lag("class").over(w.orderBy("pos")), "lo": F.min("pos").over(w), "hi": F.max("pos").over(w)})
    change = (F.col("class") != F.col("before")) & (F.col("pos") > F.col("lo")) & (F.col("pos") < F.col("hi"))
    points = v.where(change | (F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi"))).select("id", "pos", "x", "y", F.coalesce(change, F.lit(False)).alias("change"))
    # all places of a square whose diagonal is within reach are one cluster, so only squares are linked
    side = apart / math.sqrt(2) / 1.0001
    square = [F.floor(F.col(c) / side).cast("long").alias(f"b{c}") for c in ("x", "y")]
    points = settle(points.select("*", *square, F.monotonically_increasing_id().alias("num")))
    squares = settle(points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("bx", "by").agg(F.min("num").alias("square")))
    places = settle(points.select("x", "y", "bx", "by").distinct().join(squares, ["bx", "by"]))
    steps = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    step = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))).alias("s")
    to = places.select("bx", "by", F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("square").alias("dst"))
    near = places.select("x", "y", F.col("square").alias("src"), "bx", "by", step).select("x", "y", "src", (F.col("bx") + F.col("s.dx")).alias("bx"), (F.col("by") + F.col("s.dy")).alias("by")).join(to, ["bx", "by"])
    near = near.where(F.sqrt(F.pow(F.col("x") - F.col("to_x"), 2) + F.pow(F.col("y") - F.col("to_y"), 2)) <= apart)
    linked = connected_components(near.select("src", "dst").distinct())
    cluster = squares.join(linked.withColumnRenamed("node", "square"), "square", "left").select("bx", "by", F.coalesce("component", "square").alias("cluster"))
    at = points.join(cluster, ["bx", "by"], "left").withColumn("cluster", F.coalesce("cluster", -F.col("num") - 1))
    found = at.groupBy("cluster").agg(F.bool_and("change").alias("free"), F.min(F.struct("id", "pos", "x", "y")).alias("first"))
    return found.where("free").select("first.*")


def solver_bands(cells: DataFrame, n_rows: int, res: float, main_darea: float) -> DataFrame:
    """``(x, y, idx, elevation, accumulation, outlet_distance, mainchannel_darea)`` of the cells that segments cross.
    ``cells`` is ``(x, y, segment, elev, accum, outlet)``, ``segment`` being null elsewhere. Gaps get elevation 0 and
    accumulation 1; distances go straight to the nearest outlet, main-channel areas come from the nearest cell above ``main_darea``."""
    on = cells.where("segment IS NOT NULL")
    out = grow(on, cells.where("outlet")).select("x", "y", (F.col("dist") * res).alias("outlet_distance"))
    main = settle(cells.where(F.col("accum") > main_darea).select("x", "y", "accum"))
    value = grow(on, main).join(main.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("accum").alias("mainchannel_darea")), ["sx", "sy"]).select("x", "y", "mainchannel_darea")
    idx = (F.col("x") * n_rows + F.col("y")).cast("long")
    return on.select("x", "y", idx.alias("idx"), F.coalesce("elev", F.lit(0.0)).alias("elevation"), F.coalesce("accum", F.lit(1.0)).alias("accumulation")).join(out, ["x", "y"], "left").join(value, ["x", "y"], "left")


def catchments(cells: DataFrame, reaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catchments by reach, segment and component. ``cells`` is ``(x, y, land, reach_id)``, the subbasin of each cell by the
    reach it drains to (null where it drains to the sea); ``reaches`` is ``(reach_id, segment_id, catchment_id)``.

    Land without a subbasin forms coastal catchments, but for clumps that touch the edge of the table; they are
    numbered from the greatest component on, in order of their first cells. Returns ``(x, y, reach_id, segment_id, catchment_id)`` and
    ``(catchment_id, is_coastal, n_cells)``."""
    known = cells.where("reach_id IS NOT NULL").join(reaches, "reach_id").select("x", "y", "reach_id", "segment_id", "catchment_id")
    coast = settle(C.clumps(cells.where("land AND reach_id IS NULL").select("x", "y", F.lit(1).alias("one")), ["one"]).select("x", "y", "clump"))
    edge = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    touching = coast.crossJoin(F.broadcast(edge)).where("x IN (x0, x1) OR y IN (y0, y1)").select("clump").distinct()  # the edge is one row
    inner = settle(coast.select("clump").distinct().join(touching, "clump", "left_anti"))
    top = reaches.agg(F.coalesce(F.max("catchment_id"), F.lit(0)).alias("top"))
    numbered = ranked(inner, "clump").crossJoin(F.broadcast(top)).select("clump", (F.col("top") + F.col("number")).alias("catchment_id"))  # one row
    coastal = coast.join(numbered, "clump").select("x", "y", F.lit(None).cast("long").alias("reach_id"), F.lit(None).cast("long").alias("segment_id"), "catchment_id")
    every = known.unionByName(coastal.select(*(F.col(c).cast(known.schema[c].dataType) for c in known.columns)))
    size = known.groupBy("catchment_id").agg(F.lit(0).alias("is_coastal"), F.count("*").alias("n_cells")).unionByName(coastal.groupBy("catchment_id").agg(F.lit(1).alias("is_coastal"), F.count("*").alias("n_cells")).select(F.col("catchment_id").cast(known.schema["catchment_id"].dataType), "is_coastal", "n_cells"))
    return every, size


def ranked(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``number`` from 1 in the order of a unique column."""
    return running_total(values.withColumn("__one", F.lit(1)), column, "__one", "number").drop("__one")


def bank_distance(cells: DataFrame, res: float, wet: str = "water") -> DataFrame:
    """``(x, y, bank)``: metres from each wet cell to the nearest dry one, straight."""
    return grow(cells.where(F.col(wet)).select("x", "y"), cells.where(~F.col(wet))).select("x", "y", (F.col("dist") * res).alias("bank"))


def density_class(cells: DataFrame, zone: list[str], on: Column, value: str) -> DataFrame:
    """Per zone the share of cells that hold a stream and the most frequent value (smallest on ties)."""
    counts = cells.groupBy(*zone, value).agg(F.count("*").alias("k"), F.count_if(on).alias("s"))
    return counts.groupBy(*zone).agg((F.sum("s") / F.sum("k")).alias("density"), F.min(F.struct((-F.col("k")).alias("k"), F.col(value).alias("v"))).getField("v").alias("mode"))
