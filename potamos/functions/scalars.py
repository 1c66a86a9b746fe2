"""Scalar expressions: angles, deviations, boxes, cell numbers, D8 codes, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def powers(width: Column, area: Column) -> Column:
    """Logarithms and powers of scaling laws: ``{log_area, area_043, area_032, width_inverse}``, the last being the
    drainage area that goes with a width (width over 9.6, to the power of 1 / 0.32)."""
    return F.struct(F.log10(area).alias("log_area"), F.pow(area, F.lit(0.43)).alias("area_043"), F.pow(area, F.lit(0.32)).alias("area_032"), F.pow(width / 9.6, F.lit(1 / 0.32)).alias("width_inverse"))


def area_units(square_metres: Column, res: float = 30.0) -> dict[str, Column]:
    """An area in square kilometres, hectares and cells."""
    return {"km2": square_metres / 1_000_000, "hectares": square_metres * 0.0001, "cells": square_metres / (res * res)}


def insert_at(values: Column, at: Column, value: Column) -> Column:
    """An array with a value put in at a place counted from 0."""
    return F.concat(F.slice(values, F.lit(1), at), F.array(value), F.slice(values, at + 1, F.size(values)))


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest difference of two azimuths in degrees, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360)) - 180)


def percent_deviation(a: Column, b: Column) -> Column:
    return (a / b - 1) * 100


def pearson_r(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation, null where a side doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a correlation of n pairs: Student's distribution with n - 2 degrees of freedom as its finite
    sum over powers of the cosine. Null for fewer than three pairs."""
    nu, sine = n - 2, F.abs(r)
    cosine = F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))
    odd = nu % 2 == 1
    last = F.when(odd, (nu - 3) / 2).otherwise((nu - 2) / 2).cast("int")  # -1: no term
    # terms follow from each other: an odd number takes 2k / (2k + 1), an even one (2k - 1) / (2k). What they need travels
    # in the accumulator: read from outside, the values of another row were seen
    start = F.struct(F.when(odd, cosine).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("total"), (cosine * cosine).alias("square"), odd.alias("odd"))

    def add(acc: Column, k: Column) -> Column:
        factor = F.when(acc["odd"], 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / F.greatest(2 * k, F.lit(1)))
        term = F.when(k == 0, acc["term"]).otherwise(acc["term"] * factor * acc["square"])
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), acc["square"].alias("square"), acc["odd"].alias("odd"))

    steps = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    total = F.aggregate(steps, start, add)["total"]
    inside = F.when(odd, (F.asin(F.least(sine, F.lit(1.0))) + sine * total) * 2 / F.pi()).otherwise(sine * total)
    return F.when((nu > 0) & r.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))


def balance(out: Column, mainstem: Column) -> Column:
    """How far a bifurcation departs from its main branch, relative to the larger; null sides are skipped in the maximum."""
    return (out - mainstem) / F.greatest(out, mainstem)


def cell_number(col: Column, row: Column, n_rows: int) -> Column:
    """Column-major linear number of a cell; rows and columns count from 1."""
    return ((col - 1) * n_rows + (row - 1)).cast("long")


def tile_name(west: Column, south: Column) -> Column:
    """``E000000010__N000000020``: hemisphere letters and nine digits each."""

    def part(v: Column, plus: str, minus: str) -> Column:
        return F.concat(F.when(v >= 0, plus).otherwise(minus), F.format_string("%09d", F.abs(v).cast("long")))

    return F.concat(part(west, "E", "W"), F.lit("__"), part(south, "N", "S"))


#: Fixed D8 codes: direction of the step to the next cell, counted from north-east against the clock.
D8_CODES = {(1, 1): 1, (0, 1): 2, (-1, 1): 3, (-1, 0): 4, (-1, -1): 5, (0, -1): 6, (1, -1): 7, (1, 0): 8, (0, 0): 0}


def d8_code(dx: Column, dy: Column) -> Column:
    """D8 code of a step, by the signs of its parts."""
    sx, sy = F.signum(dx).cast("int"), F.signum(dy).cast("int")
    code = F.lit(None).cast("int")
    for (x, y), k in D8_CODES.items():
        code = F.when((sx == x) & (sy == y), k).otherwise(code)
    return code


def parse_tags(text: Column) -> Column:
    """Map of a ``"k"=>"v","k2"=>"v2"`` string."""
    inner = F.regexp_replace(text, r'^\s*"|"\s*$', "")
    return F.when(text.isNotNull(), F.str_to_map(inner, F.lit(r'"\s*,\s*"'), F.lit('"=>"')))


def first_tag(tags: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_element_at(tags, F.lit(n)) for n in names))


def box_area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return (maxx - minx) * (maxy - miny)


def boxes_overlap(a: str, b: str) -> Column:
    """Whether the boxes of the two aliases share an interior."""
    c = F.col
    return (c(f"{a}.minx") < c(f"{b}.maxx")) & (c(f"{b}.minx") < c(f"{a}.maxx")) & (c(f"{a}.miny") < c(f"{b}.maxy")) & (c(f"{b}.miny") < c(f"{a}.maxy"))


def box_contains(a: str, b: str) -> Column:
    """Whether box ``a`` holds box ``b``."""
    c = F.col
    return (c(f"{a}.minx") <= c(f"{b}.minx")) & (c(f"{a}.maxx") >= c(f"{b}.maxx")) & (c(f"{a}.miny") <= c(f"{b}.miny")) & (c(f"{a}.maxy") >= c(f"{b}.maxy"))


def node_type(declared: Column, kind: Column, coast: Column, degree: Column) -> Column:
    """Type of a node: a declared type stays; else by junction kind; ends are outlets by where they lie, or inlets;
    what is left is a confluence."""
    return (
        F.when((degree == 1) & (coast == "sink"), "sink_outlet")
        .when((degree == 1) & (coast == "coast"), "coastal_outlet")
        .when(declared.isNotNull(), declared)
        .when(kind == "b", "bifurcation")
        .when(kind == "c", "confluence")
        .when(degree == 1, "inlet")
        .otherwise("confluence")
    )
