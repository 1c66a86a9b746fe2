"""Aggregation of areas into domains, and components shared by domains. The tables here are small by nature (a row
per basin or domain); a region's basins are merged in one task."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Rounds, settle


Box = tuple[float, float, float, float]
OBJECTIVES = ("compactness", "compactness_change", "area_ratio", "area_deficit", "non_overlapping_ratio")


def _size(b: Box) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def _union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _meet(a: Box, b: Box, by: float = 0.0) -> bool:
    return a[0] <= b[2] + by and b[0] <= a[2] + by and a[1] <= b[3] + by and b[1] <= a[3] + by


def _holds(a: Box, b: Box) -> bool:
    return a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]


def _overlap(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _gap(a: Box, b: Box) -> float:
    return max(0.0, a[0] - b[2], b[0] - a[2]) ** 2 + max(0.0, a[1] - b[3], b[1] - a[3]) ** 2


def _items(pdf: pd.DataFrame) -> dict[int, tuple[Box, float, list[int]]]:
    return {int(r.id): ((r.minx, r.miny, r.maxx, r.maxy), float(r.area), [int(r.id)]) for r in pdf.itertuples()}


def _named(groups) -> pd.DataFrame:
    return pd.DataFrame([(m, min(members)) for members in groups for m in members], columns=["id", "domain"]).astype("int64")


def agglomerate(basins: DataFrame, max_area: float, objectives: tuple[str, ...] = ("compactness_change",), ignore_area: float = 0.0, buffer: float = 0.0) -> DataFrame:
    """``(id, domain)``: greedy merging of neighbouring boxes inside each region. Of the pairs whose merged envelope stays
    within ``max_area`` and whose compactness (area over envelope area) doesn't fall, the one of the greatest product of
    ``objectives`` merges, until none is left; boxes inside another envelope are then absorbed by the nearest. Basins up
    to ``ignore_area`` are left out; neighbours are boxes at most ``buffer`` apart. Ties go to the smallest ids; a domain
    is named by its smallest basin.

    The objectives are those of ``OBJECTIVES``: compactness and its change, the envelope's share of ``max_area`` and the
    rest of it, and the share of the envelope that no third box of the region overlaps."""
    if unknown := set(objectives) - set(OBJECTIVES):
        raise ValueError(f"unknown objectives {sorted(unknown)}")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        items = {k: v for k, v in _items(pdf).items() if v[1] > ignore_area}

        def value(i: int, j: int) -> tuple[float, Box] | None:
            a, b = items[i], items[j]
            u = _union(a[0], b[0])
            compact = (a[1] + b[1]) / _size(u)
            change = compact - (a[1] + b[1]) / (_size(a[0]) + _size(b[0]))
            if not _meet(a[0], b[0], buffer) or _size(u) > max_area or change < 0:
                return None
            known = {"compactness": compact, "compactness_change": change, "area_ratio": _size(u) / max_area, "area_deficit": 1 - _size(u) / max_area}
            if "non_overlapping_ratio" in objectives:
                known["non_overlapping_ratio"] = max(0.0, 1 - sum(_overlap(u, x[0]) for k, x in items.items() if k not in (i, j)) / _size(u))
            return math.prod(known[o] for o in objectives), u

        while True:
            found = [(v[0], -i, -j, v[1]) for i in items for j in items if i < j and (v := value(i, j)) is not None]
            if not found:
                break
            _, i, j, u = max(found)
            a, b = items.pop(-i), items.pop(-j)
            items[-i] = (u, a[1] + b[1], a[2] + b[2])
        for i in sorted(items, key=lambda k: (_size(items[k][0]), k)):
            around = [j for j in sorted(items) if i != j and _holds(items[j][0], items[i][0])]
            if around:
                j, gone = min(around, key=lambda k: (_gap(items[k][0], items[i][0]), k)), items.pop(i)
                items[j] = (items[j][0], items[j][1] + gone[1], items[j][2] + gone[2])
        return _named(members for _, _, members in items.values())

    return basins.groupBy("region").applyInPandas(merge, "id long, domain long")


def grow_domains(basins: DataFrame, max_area: float, way: str = "largest", max_distance: float | None = None, min_compactness: float | None = None) -> DataFrame:
    """``(id, domain)``: domains grown one after the other inside each region, the older ways of doing it, on boxes.

    ``within_distance`` and ``largest`` start from the largest basin left and take others in one pass by distance, then
    by area (largest first) or by overlap (least first) and compactness (greatest first). ``most_compact`` starts from the basin of least
    compactness and takes, again and again, of those that meet its envelope the farthest, then the most compact. An
    envelope never exceeds ``max_area``; ``max_distance`` and ``min_compactness`` limit what may join; basins inside a
    finished envelope join it. Ties go to the smallest ids."""
    if way not in ("within_distance", "largest", "most_compact"):
        raise ValueError(way)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        left, groups = _items(pdf), []
        while left:
            start = min(left, key=lambda k: (left[k][1] / _size(left[k][0]) if way == "most_compact" else -left[k][1], k))
            box, area, members = left.pop(start)
            members = list(members)

            def joins(k: int) -> bool:
                u = _union(box, left[k][0])
                return _size(u) <= max_area and (min_compactness is None or way == "within_distance" or (area + left[k][1]) / _size(u) >= min_compactness)

            def take(k: int) -> None:
                nonlocal box, area
                box, area = _union(box, left[k][0]), area + left[k][1]
                members.append(k)
                del left[k]

            compact = lambda k: (area + left[k][1]) / _size(_union(box, left[k][0]))
            if way == "most_compact":
                while near := [k for k in left if _meet(box, left[k][0])]:
                    inside = [k for k in near if _holds(box, left[k][0])]
                    for k in inside:
                        take(k)
                    near = [k for k in near if k in left and joins(k)]
                    if not near:
                        break
                    take(min(near, key=lambda k: (-_gap(box, left[k][0]), -compact(k), k)))
            else:
                near = [k for k in left if max_distance is None or _gap(box, left[k][0]) <= max_distance**2]
                rank = (lambda k: (_gap(box, left[k][0]), -left[k][1], k)) if way == "within_distance" else (lambda k: (_gap(box, left[k][0]), _overlap(box, left[k][0]), -compact(k), k))
                for k in sorted(near, key=rank):
                    if joins(k):
                        take(k)
            for k in [k for k in left if _holds(box, left[k][0])]:
                take(k)
            groups.append(members)
        return _named(groups)

    return basins.groupBy("region").applyInPandas(grow, "id long, domain long")


def allocate_components(nodes: DataFrame, skip_given: bool = True) -> DataFrame:
    """``(domain, comp)``: which domains keep a component that several hold. ``nodes`` is ``(domain, comp, x, y)``;
    components are the same where nodes of theirs coincide.

    Domains are taken in order. A component without an overlap is kept; one that meets several components of another
    domain is kept; one that meets a single component is kept if it has at least as many nodes, and the other is then
    given away. Components given away are left out of what later domains see and, with ``skip_given``, of what they
    hold themselves. One round per domain, over its overlaps only."""
    sizes = settle(nodes.groupBy("domain", "comp").agg(F.count("*").alias("n")))
    a, b = nodes.alias("a"), nodes.alias("b")
    same = a.join(b, ["x", "y"]).where("a.domain <> b.domain").select(F.col("a.domain").alias("domain"), F.col("a.comp").alias("comp"), F.col("b.domain").alias("o_domain"), F.col("b.comp").alias("o_comp")).distinct()
    other = sizes.select(F.col("domain").alias("o_domain"), F.col("comp").alias("o_comp"), F.col("n").alias("o_n"))
    same = settle(same.join(sizes, ["domain", "comp"]).join(other, ["o_domain", "o_comp"]))
    order = [r.domain for r in same.select("domain").distinct().orderBy("domain").collect()]  # a row per domain
    given, taken = Rounds(nodes.sparkSession), Rounds(nodes.sparkSession)
    away = given.add(sizes.select(F.col("domain").alias("o_domain"), F.col("comp").alias("o_comp")).limit(0))
    for domain in order:
        away = given.all().select("o_domain", "o_comp")
        met = same.where(F.col("domain") == domain).join(away, ["o_domain", "o_comp"], "left_anti")
        if skip_given:
            met = met.join(away.where(F.col("o_domain") == domain).select(F.col("o_comp").alias("comp")), "comp", "left_anti")
        ways = met.groupBy("comp", "o_domain", "n").agg(F.count("*").alias("k"), F.min("o_comp").alias("o_comp"), F.min("o_n").alias("o_n"))
        ways = ways.withColumn("keeps", (F.col("k") > 1) | (F.col("n") >= F.col("o_n")))
        ways = taken.add(ways.select(F.lit(domain).alias("domain"), "comp", "o_domain", "o_comp", "k", "keeps"))
        given.add(ways.where("keeps AND k = 1").select("o_domain", "o_comp"))
    away = given.all().select(F.col("o_domain").alias("domain"), F.col("o_comp").alias("comp")).distinct()
    if not order:
        return sizes.select("domain", "comp")
    decided = taken.all().groupBy("domain", "comp").agg(F.bool_or("keeps").alias("keeps"))
    kept = sizes.join(decided, ["domain", "comp"], "left")
    if skip_given:  # given away before its own domain's turn, unless that domain had taken it already
        kept = kept.join(away.withColumn("away", F.lit(True)), ["domain", "comp"], "left").where("coalesce(keeps, away IS NULL)")
    else:
        kept = kept.where("coalesce(keeps, true)")
    return kept.select("domain", "comp")
