"""River names: taken over from the nearest named lines, and spread along unnamed ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potamos.functions import scalars as S

from . import network as N
from . import spatial as P
from .components import connected_components
from .lineage import settle


def river_names(pieces: DataFrame, named: DataFrame, max_dist: float = 1000.0, start: float = 500.0) -> DataFrame:
    """``(id, named_id, local, en)`` of the segments that a named line follows. ``pieces`` is ``(id, seq, length, x, y)``,
    the segments in short parts; ``named`` is ``(id, x, y, name, other_tags)``.

    Every part looks for its nearest named line, however far. A segment of more than three parts goes without a name if
    the distance changes steadily along it (Pearson's r beyond 0.5 with p below 0.005), and any segment if more than half
    of its parts are beyond ``max_dist``. Otherwise the most frequent line names it (smallest id on ties); ``en`` is
    the first of its tags name:en, int_name and name:fr."""
    at = pieces.join(P.nearest_places(pieces, named.select("id", "x", "y"), start), ["x", "y"])
    along = F.sum("length").over(Window.partitionBy("id").orderBy("seq"))
    facts = at.withColumn("along", along).groupBy("id").agg(
        F.count("*").alias("n"), S.pearson_r(F.col("along"), F.col("dist")).alias("r"), F.count_if(F.col("dist") > max_dist).alias("far"), F.mode("to_id", deterministic=True).alias("named_id")
    )
    steady = (F.col("n") > 3) & (F.abs("r") > 0.5) & (S.pearson_p(F.col("r"), F.col("n")) < 0.005)
    best = facts.where(~F.coalesce(steady, F.lit(False)) & (F.col("far") / F.col("n") <= 0.5)).select("id", "named_id")
    tags = S.parse_tags(F.col("other_tags"))
    labels = named.select(F.col("id").alias("named_id"), F.col("name").alias("local"), S.first_tag(tags, "name:en", "int_name", "name:fr").alias("en"))
    return best.join(labels, "named_id").select("id", "named_id", "local", "en")


def fill_names(lines: DataFrame, max_length: int = 20, priority: str | None = None) -> DataFrame:
    """``(id, name)`` for unnamed lines that lie between nodes of the same name. ``lines`` is ``(id, start_node, end_node,
    name, comp)`` and the ``priority`` column, if one is named.

    Names of a component fill in order of their sum of ``priority`` (of their number of lines without it), then by name.
    A name's open nodes are its lines' ends with a line to a node it doesn't touch. All simple paths of at most
    ``max_length`` lines between open nodes are taken, inside the graph of nodes that unnamed lines touch; unnamed
    lines between any two nodes of those paths get the name. One task per connected piece of that graph."""
    blank = lines.where("name IS NULL")
    nan_nodes = N.incidence(blank).select("node").distinct()
    at = lambda c: nan_nodes.select(F.col("node").alias(c))
    inside = settle(lines.select("id", "start_node", "end_node", "comp", F.col("name").isNull().alias("blank")).join(at("start_node"), "start_node", "left_semi").join(at("end_node"), "end_node", "left_semi"))
    pieces = settle(connected_components(inside.select(F.col("start_node").alias("src"), F.col("end_node").alias("dst"))))
    edges = inside.join(pieces.select(F.col("node").alias("start_node"), F.col("component").alias("piece")), "start_node")
    named = lines.where("name IS NOT NULL")
    weight = F.sum(priority) if priority else F.count("*")
    rank = named.groupBy("comp", "name").agg(weight.cast("double").alias("prior"))
    touch = N.incidence(named).join(named.select(F.col("id").alias("line"), "comp", "name"), "line").select("comp", "name", "node").distinct()
    around = lines.select(F.col("start_node").alias("node"), F.col("end_node").alias("other")).union(lines.select("end_node", "start_node"))
    far = touch.join(around, "node").join(touch.select("comp", "name", F.col("node").alias("other"), F.lit(True).alias("same")), ["comp", "name", "other"], "left")
    open_nodes = far.where("same IS NULL").select("comp", "name", "node").distinct().join(rank, ["comp", "name"]).join(pieces.withColumnRenamed("component", "piece"), "node")
    none = lambda kind: F.lit(None).cast(kind)
    rows = edges.select("piece", "comp", "id", F.col("start_node").alias("a"), F.col("end_node").alias("b"), "blank", none("string").alias("name"), none("double").alias("prior"))
    rows = rows.unionByName(open_nodes.select("piece", "comp", none("long").alias("id"), F.col("node").alias("a"), F.col("node").alias("b"), none("boolean").alias("blank"), "name", "prior"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        lines_here = [(int(r.id), int(r.a), int(r.b), r.comp) for r in pdf[pdf.id.notna()].itertuples()]
        blank_here = {int(i) for i in pdf[pdf.blank == True].id}  # noqa: E712
        touching = pdf[pdf.id.isna()]
        out: dict[int, str] = {}
        groups = sorted(((-g.prior.iloc[0], str(name), comp, {int(x) for x in g.a}) for (comp, name), g in touching.groupby(["comp", "name"])), key=lambda x: x[:3])
        for _, name, comp, ends in groups:
            nan_here = {n for i, a, b, c in lines_here if i in blank_here and c == comp for n in (a, b)}
            near: dict[int, set[int]] = {}
            for _, a, b, _ in lines_here:
                if a in nan_here and b in nan_here and a != b:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
            chosen = ends & nan_here
            on_path = path_nodes(near, chosen, max_length)
            for i, a, b, c in lines_here:
                if i in blank_here and a in on_path and b in on_path:
                    out[i] = name
            blank_here -= set(out)
        return pd.DataFrame({"id": pd.Series(list(out), dtype="int64"), "name": pd.Series(list(out.values()), dtype="str")})

    return rows.groupBy("piece").applyInPandas(fill, "id long, name string")


def path_nodes(near: dict[int, set[int]], ends: set[int], longest: int) -> set[int]:
    """Nodes on simple paths of at most ``longest`` steps between two of ``ends``. Steps that can't reach an end in what is
    left of the length aren't taken."""
    away, front, d = {e: 0 for e in ends}, list(ends), 0
    while front:
        d += 1
        front = [m for n in front for m in near.get(n, ()) if away.setdefault(m, d) == d and m not in ends]
        front = list(dict.fromkeys(front))
    found: set[int] = set()
    for start in sorted(ends):
        path, on = [start], {start}
        stack = [iter(sorted(near.get(start, ())))]
        while stack:
            for node in stack[-1]:
                if node in on or len(path) - 1 + 1 + away.get(node, longest + 1) > longest:
                    continue
                if node in ends and node > start:
                    found.update(path)
                    found.add(node)
                path.append(node)
                on.add(node)
                stack.append(iter(sorted(near.get(node, ()))))
                break
            else:
                stack.pop()
                on.discard(path.pop())
    return found
