"""Lines as tables of vertices ``(id, pos, x, y)``: measures, densifying, shapes of new lines, transects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(vertices: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos")
    return vertices.withColumns({"to_x": F.lead("x").over(w), "to_y": F.lead("y").over(w)})


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def line_measures(vertices: DataFrame) -> DataFrame:
    """``(id, length, azimuth, sinuosity)``: length along the line, direction from its first to its last vertex, and
    length over the straight distance (null where that is 0)."""
    s = _steps(vertices)
    step = F.sqrt(F.pow(F.col("to_x") - F.col("x"), 2) + F.pow(F.col("to_y") - F.col("y"), 2))
    m = s.groupBy("id").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    straight = F.sqrt(dx * dx + dy * dy)
    return m.select("id", "length", azimuth(dx, dy).alias("azimuth"), F.when(straight > 0, F.col("length") / straight).alias("sinuosity"))


def dense_lines(vertices: DataFrame, res: float = 30.0) -> DataFrame:
    """``(id, pos, x, y)`` with a vertex for every cell: arcs of a whole number of cells, straight or diagonal, are
    filled; all others stay as they are. Positions count from 0."""
    gap = F.sqrt(F.pow(F.col("to_x") - F.col("x"), 2) + F.pow(F.col("to_y") - F.col("y"), 2))
    diagonal, straight = F.round(gap / F.sqrt(F.lit(2 * res * res)), 14), gap / res
    whole = lambda c: (c > 1) & (c == F.floor(c))
    n = F.when(whole(straight), straight).when(whole(diagonal), diagonal).otherwise(1.0).cast("int")
    arcs = _steps(vertices).where("to_x IS NOT NULL").withColumn("n", n)
    inner = arcs.select("id", "pos", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "n", "x", "y", "to_x", "to_y")
    at = lambda a, b: F.when(F.col("k") == F.col("n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n"))
    filled = inner.select("id", "pos", "k", at("x", "to_x").alias("x"), at("y", "to_y").alias("y"))
    first = vertices.groupBy("id").agg(F.min_by(F.struct("x", "y"), "pos").alias("p"), F.min("pos").alias("pos")).select("id", "pos", F.lit(0).alias("k"), "p.x", "p.y")
    w = Window.partitionBy("id").orderBy("pos", "k")
    return first.unionByName(filled).select("id", (F.row_number().over(w) - 1).alias("pos"), "x", "y")


def missing_vertices(dense: DataFrame, cells: DataFrame) -> DataFrame:
    """``(id, pos, at_end)``: vertices of dense lines that have no cell, and whether they are a line's first or last."""
    w = Window.partitionBy("id")
    ends = dense.withColumns({"lo": F.min("pos").over(w), "hi": F.max("pos").over(w)})
    gone = ends.join(cells.select("x", "y").distinct(), ["x", "y"], "left_anti")
    return gone.select("id", "pos", ((F.col("pos") == F.col("lo")) | (F.col("pos") == F.col("hi"))).alias("at_end"))


def joining_lines(pairs: DataFrame) -> DataFrame:
    """Vertices ``(id, pos, x, y)`` of new lines for ``(id, ax, ay, bx, by)``: straight where that is straight or
    diagonal on the grid, else first diagonal and then straight."""
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    short = F.least(dx, dy)
    bend = F.struct((F.col("ax") - short * F.signum(F.col("ax") - F.col("bx"))).alias("x"), (F.col("ay") - short * F.signum(F.col("ay") - F.col("by"))).alias("y"))
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    shape = F.when((short == 0) | (dx == dy), F.array(a, b)).otherwise(F.array(a, bend, b))
    return pairs.select("id", F.posexplode(shape).alias("pos", "p")).select("id", "pos", "p.x", "p.y")


def transects(vertices: DataFrame, every: float, half_width: Column) -> DataFrame:
    """``(id, k, x, y, ax, ay, bx, by)``: cross lines at every ``every`` along each line (from half of that on), at right
    angles to the arc they stand on, reaching ``half_width`` (a column of ``vertices``) to the left (a) and right (b)."""
    w = Window.partitionBy("id").orderBy("pos")
    step = F.sqrt(F.pow(F.col("to_x") - F.col("x"), 2) + F.pow(F.col("to_y") - F.col("y"), 2))
    arcs = _steps(vertices.withColumn("half", half_width)).where("to_x IS NOT NULL").withColumn("step", step).where("step > 0")
    arcs = arcs.withColumn("upto", F.sum("step").over(w)).withColumn("since", F.col("upto") - F.col("step"))
    low, high = F.ceil(F.col("since") / every - 0.5), F.ceil(F.col("upto") / every - 0.5) - 1
    at = arcs.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    share = (F.col("k") * every + every / 2 - F.col("since")) / F.col("step")
    ux, uy = (F.col("to_x") - F.col("x")) / F.col("step"), (F.col("to_y") - F.col("y")) / F.col("step")
    at = at.withColumns({"px": F.col("x") + share * (F.col("to_x") - F.col("x")), "py": F.col("y") + share * (F.col("to_y") - F.col("y")), "ux": ux, "uy": uy})
    side = lambda c, d, sign: F.col(c) + sign * F.col(d) * F.col("half")
    return at.select("id", "k", F.col("px").alias("x"), F.col("py").alias("y"), side("px", "uy", -1).alias("ax"), side("py", "ux", 1).alias("ay"), side("px", "uy", 1).alias("bx"), side("py", "ux", -1).alias("by"))


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (an array of ``{x, y}``, closed or not), by counting crossings of a ray to the right.
    Points on the ring itself are out. Products instead of slopes, so whole numbers are decided exactly."""
    n = F.size(ring)

    def side(i: Column) -> tuple[Column, Column, Column]:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))
        return a, b, (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])

    def crossing(i: Column) -> Column:
        a, b, turn = side(i)
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles & F.when(b["y"] > a["y"], turn > 0).otherwise(turn < 0), 1).otherwise(0)

    def touches(i: Column) -> Column:
        a, b, turn = side(i)
        return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    sides = F.sequence(F.lit(1), n)
    return (F.aggregate(sides, F.lit(0), lambda acc, i: acc + crossing(i)) % 2 == 1) & ~F.exists(sides, touches)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``(id, polygon_id)`` of points and the polygons ``(id, ring)`` that hold them: boxes through buckets, then the ring."""
    from .spatial import boxes_holding

    low = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    boxes = polygons.select("id", "ring", low("x", F.array_min).alias("minx"), low("y", F.array_min).alias("miny"), low("x", F.array_max).alias("maxx"), low("y", F.array_max).alias("maxy"))
    near = boxes_holding(points.select("id", "x", "y"), boxes, size)
    at = near.join(points.select("id", "x", "y"), "id").join(polygons.select(F.col("id").alias("box_id"), "ring"), "box_id")
    return at.where(inside_polygon(F.col("x"), F.col("y"), F.col("ring"))).select("id", F.col("box_id").alias("polygon_id"))
