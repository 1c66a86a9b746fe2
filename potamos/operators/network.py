"""Relational operators on river networks: lines ``(id, start_node, end_node, ...)`` and nodes ``(id, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potamos.functions import scalars as S


def incidence(lines: DataFrame) -> DataFrame:
    """``(node, line, role)``: each end of each line. A self loop has two rows."""
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.lit("out").alias("role")), F.struct(F.col("end_node").alias("node"), F.lit("in").alias("role"))))
    return lines.select(F.col("id").alias("line"), ends.alias("e")).select("e.node", "line", "e.role")


def node_table(lines: DataFrame) -> DataFrame:
    """``(id, line_cats, n_lines)``: the distinct lines of each node, ascending."""
    return incidence(lines).groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_set("line")).alias("line_cats"), F.countDistinct("line").alias("n_lines"))


def degrees(lines: DataFrame) -> DataFrame:
    """``(node, n_lines, n_in, n_out)``; partial sums before the shuffle, so hubs cost no more than others."""
    return incidence(lines).groupBy("node").agg(F.count("*").alias("n_lines"), F.count_if(F.col("role") == "in").alias("n_in"), F.count_if(F.col("role") == "out").alias("n_out"))


def with_attributes(df: DataFrame, attributes: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Left join of a column subset by a unique key."""
    return df.join(attributes.select(key, *columns) if columns else attributes, key, "left")


def overlay(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Column-wise overlay: values of ``source`` win, keys that only it has are added."""
    s = source.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(s, key, "full_outer")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def other_end(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``(node, line, other)``: lines at the given nodes with the node on the far side."""
    at = incidence(lines).join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return at.join(lines.select(F.col("id").alias("line"), "start_node", "end_node"), "line").select("node", "line", F.when(F.col("role") == "out", F.col("end_node")).otherwise(F.col("start_node")).alias("other"))


def prune(lines: DataFrame, nodes: DataFrame, column: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop lines and nodes whose ``column`` is among ``values``."""
    return lines.join(values, column, "left_anti"), nodes.join(values, column, "left_anti")


def split(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Complementary parts; rows where the predicate is null count as good."""
    is_bad = F.coalesce(bad, F.lit(False))
    return df.where(~is_bad), df.where(is_bad)


def flip(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Swap the ends of the lines whose id is in ``flagged``; adds ``flipped``."""
    marked = lines.join(flagged.select("id").distinct().withColumn("flipped", F.lit(True)), "id", "left").withColumn("flipped", F.coalesce("flipped", F.lit(False)))
    swapped = {"start_node": F.when(F.col("flipped"), F.col("end_node")).otherwise(F.col("start_node")), "end_node": F.when(F.col("flipped"), F.col("start_node")).otherwise(F.col("end_node"))}
    return marked.withColumns(swapped)


def fix_links(matches: DataFrame, min_share: float = 0.9, tolerance: float = 10.0) -> DataFrame:
    """``(line, upstream_node)`` for segments laid under a line of known direction. ``matches`` is ``(line, start_node,
    end_node, share, azimuth, fix_azimuth)``; those that share more than ``min_share`` of their length count. The same
    direction makes the start node the upper one, the opposite the end node; anything between is an error."""
    d = S.angle_difference(F.col("fix_azimuth"), F.col("azimuth"))
    wrong = F.raise_error(F.format_string("line %d crosses its match by %s degrees", "line", F.col("d").cast("string"))).cast("long")
    found = matches.where(F.col("share") > min_share).withColumn("d", d)
    return found.select("line", F.when(F.col("d") < tolerance, F.col("start_node")).when(F.col("d") > 180 - tolerance, F.col("end_node")).otherwise(wrong).alias("upstream_node"))


def _pair() -> list[Column]:
    return [F.least("start_node", "end_node"), F.greatest("start_node", "end_node")]


def parallel_lines(lines: DataFrame) -> DataFrame:
    """Lines that share both ends with another one, whatever the direction; ``rank`` orders them by length, then id."""
    w = Window.partitionBy(*_pair())
    return lines.withColumn("n_parallel", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("length", "id"))).where("n_parallel > 1 AND start_node <> end_node")


def simple_graph(lines: DataFrame, directed: bool = False) -> DataFrame:
    """Collapse parallel edges; the one of the highest id stays."""
    pair = [F.col("start_node"), F.col("end_node")] if directed else _pair()
    return lines.groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.max("id").alias("id"))


def clean_small_loops(lines: DataFrame, nodes: DataFrame, factor: float) -> DataFrame:
    """Ids of the longest line of each parallel pair that is short against the mean width of its nodes."""
    n = nodes.select(F.col("id").alias("node"), "river_width")
    wide = lines.join(n.select(F.col("node").alias("start_node"), F.col("river_width").alias("w1")), "start_node", "left").join(n.select(F.col("node").alias("end_node"), F.col("river_width").alias("w2")), "end_node", "left")
    short = wide.where((F.col("start_node") != F.col("end_node")) & (F.col("length") < (F.col("w1") + F.col("w2")) / 2 * factor))
    return short.groupBy(_pair()[0].alias("a"), _pair()[1].alias("b")).agg(F.count("*").alias("n"), F.max(F.struct("length", (-F.col("id")).alias("neg"))).alias("top")).where("n > 1").select((-F.col("top.neg")).alias("id"))


def dangles(lines: DataFrame) -> DataFrame:
    """Lines with exactly one end of degree 1: ``(id, dangle_node, inner_node, length)``."""
    d = degrees(lines).select("node", "n_lines")
    both = lines.join(d.select(F.col("node").alias("start_node"), F.col("n_lines").alias("d1")), "start_node").join(d.select(F.col("node").alias("end_node"), F.col("n_lines").alias("d2")), "end_node")
    one = both.where((F.col("d1") == 1) != (F.col("d2") == 1))
    return one.select("id", F.when(F.col("d1") == 1, F.col("start_node")).otherwise(F.col("end_node")).alias("dangle_node"), F.when(F.col("d1") == 1, F.col("end_node")).otherwise(F.col("start_node")).alias("inner_node"), "length")


def short_dangles(lines: DataFrame, nodes: DataFrame, min_length: float) -> DataFrame:
    """Dangles that go, by the tip they are seen from: shorter than the minimum, and the tip is no outlet. Where several
    meet at a three-way node the longest stays, and none goes where lines of the inner node share a far node, as that
    would leave a loop. A line on its own has two tips and is seen from both."""
    lines = lines.where("start_node <> end_node")
    d = degrees(lines).select("node", "n_lines")
    outlets = nodes.where("is_outlet = 1").select("id")
    tips = d.where("n_lines = 1").select(F.col("node").alias("id")).join(outlets, "id", "left_anti")
    short = other_end(tips, lines).join(lines.select(F.col("id").alias("line"), "length"), "line").where(F.col("length") < min_length)
    short = short.join(d.select(F.col("node").alias("other"), F.col("n_lines").alias("inner_degree")), "other")
    w = Window.partitionBy("other")
    ranked = short.withColumns({"k": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("length"), "line"))}).where("NOT (inner_degree = 3 AND k > 1 AND rank = 1)")
    around = other_end(ranked.select(F.col("other").alias("id")).distinct(), lines)
    loops = around.groupBy(F.col("node").alias("inner_node")).agg(F.countDistinct("other").alias("a"), F.countDistinct("line").alias("b")).where("a <> b")
    kept = ranked.select(F.col("line").alias("id"), F.col("node").alias("dangle_node"), F.col("other").alias("inner_node"), "length")
    return kept.join(loops, "inner_node", "left_anti").select("id", "dangle_node", "inner_node", "length")


def topology_ids(lines: DataFrame) -> DataFrame:
    """``(id, upstream_line_ids, downstream_line_ids)`` as comma lists, empty (not null) at inlets and outlets."""

    def joined(key: str, other: str, name: str) -> DataFrame:
        ids = lines.groupBy(F.col(other).alias(key)).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        return ids.select(key, F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias(name))

    up, down = joined("start_node", "end_node", "upstream_line_ids"), joined("end_node", "start_node", "downstream_line_ids")
    both = lines.select("id", "start_node", "end_node").join(up, "start_node", "left").join(down, "end_node", "left")
    return both.select("id", F.coalesce("upstream_line_ids", F.lit("")).alias("upstream_line_ids"), F.coalesce("downstream_line_ids", F.lit("")).alias("downstream_line_ids"))


def width_shares(lines: DataFrame) -> DataFrame:
    """Share of each line in the width leaving its start node, and whether it is the main branch (widest, then first)."""
    w = Window.partitionBy("start_node")
    return lines.withColumn("share", F.col("width") / F.sum("width").over(w)).withColumn("is_mainstem", (F.row_number().over(w.orderBy(F.desc("width"), "id")) == 1).cast("int"))


def component_summary(lines: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per component: inlets, outlets, share of coastal nodes, and validity (an inlet, an outlet, not all coast)."""
    d = degrees(lines).select(F.col("node").alias("id"), "n_lines")
    n = members.select(F.col("node").alias("id"), "component").join(nodes, "id").join(d, "id")
    agg = n.groupBy("component").agg(
        F.count("*").alias("n_nodes"),
        F.bool_or((F.col("n_lines") == 1) & (F.col("is_outlet") == 0)).alias("has_inlet"),
        F.bool_or(F.col("is_outlet") == 1).alias("has_outlet"),
        (F.count_if(F.col("grwl_value") == 126) / F.count("*")).alias("coastal_share"),
    )
    return agg.withColumn("is_valid", F.col("has_inlet") & F.col("has_outlet") & (F.col("coastal_share") <= 0.95))


def select_components(lines: DataFrame, nodes: DataFrame, members: DataFrame, inside: Column, min_darea: float) -> DataFrame:
    """Lines of the components worth keeping, with ``component``: at least half of the nodes other than outlets are
    ``inside``, and the component is valid. One without an outlet gets one at the node that drains most, if that is
    ``min_darea`` or more."""
    n = members.select(F.col("node").alias("id"), "component").join(nodes, "id")
    share = n.where("is_outlet = 0").groupBy("component").agg(F.avg(inside.cast("double")).alias("share")).where("share >= 0.5")
    here = n.join(share.select("component"), "component", "left_semi")
    top = here.groupBy("component").agg(F.max("is_outlet").alias("any_outlet"), F.max(F.struct("darea", (-F.col("id")).alias("neg"))).alias("top"))
    new = (F.col("any_outlet") == 0) & (F.col("top.darea") >= min_darea) & (F.col("id") == -F.col("top.neg"))
    marked = here.join(top, "component").withColumn("is_outlet", F.when(new, 1).otherwise(F.col("is_outlet"))).drop("component", "any_outlet", "top")
    valid = component_summary(lines, marked, members).where("is_valid")
    at = members.select(F.col("node").alias("start_node"), "component").join(valid.select("component"), "component", "left_semi")
    return lines.join(at, "start_node")
