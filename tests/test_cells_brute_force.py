"""Raster stages against plain Python on the tables of their queries."""

import math

import pytest

from potamos.operators import cells as C
from potamos.plans import registry
from potamos.sources.derived import Tables

from .conftest import SF

NEAR4 = [(0, 1), (1, 0), (0, -1), (-1, 0)]
NEAR8 = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@pytest.fixture(scope="module")
def raster(spark):
    return {(r.x, r.y): r for r in Tables(spark, SF).raster.collect()}


def clumps_of(cells, around):
    """``cells``: place -> value; the members of each clump of equal values."""
    seen, out = set(), []
    for c in sorted(cells):
        if c in seen:
            continue
        work, held = [c], {c}
        while work:
            x, y = work.pop()
            for dx, dy in around:
                n = (x + dx, y + dy)
                if n not in held and cells.get(n, ...) == cells[c]:
                    held.add(n)
                    work.append(n)
        seen |= held
        out.append(held)
    return out


def nearest(c, seeds):
    return min(seeds, key=lambda s: (math.dist(c, s), s[0] * 2**32 + s[1]))


def test_river_mask(spark, raster):
    wet = {c for c, r in raster.items() if r.grwl is not None}
    near = {c: raster[nearest(c, wet)].grwl for c in raster}
    want = {}
    for held in clumps_of({c: c in wet for c in raster}, NEAR4):
        km2, mean = len(held) * 0.3, sum(near[c] for c in held) / len(held)
        for c in held:
            if c in wet or (mean == 180 and km2 < 2.0) or km2 < 1.0:
                want[c] = near[c]
    got = {(r.x, r.y): r.grwl for r in registry.queries()["o_r01_fill_river_mask"](spark, SF).collect()}
    assert got == want and len(want) > len(wet)


def test_extended_coast(spark, raster):
    wet = {c: r.grwl for c, r in raster.items() if r.land and r.coast_dist < 1500 and r.grwl not in (None, 180)}
    dry, land = set(raster) - set(wet), {c for c, r in raster.items() if r.land}
    clump, widest = {}, {}
    for held in clumps_of(wet, NEAR4):
        for c in held:
            clump[c] = min(held)
        widest[min(held)] = max(math.dist(c, nearest(c, dry)) * 30 for c in held)
    want = {}
    for c, r in raster.items():
        if r.land:
            if r.grwl is not None:
                want[c] = r.grwl
        else:
            at = clump.get(nearest(c, land))
            if at is not None and r.coast_dist < widest[at] * 6:
                want[c] = wet[at]
    got = {(r.x, r.y): r.grwl for r in registry.queries()["o_r02_extend_coast"](spark, SF).collect()}
    assert got == want and any(not raster[c].land for c in want)


def test_tidal_clumps_and_clumps(spark):
    cells = {(r.x, r.y): r for r in Tables(spark, SF).cells.collect()}
    q = registry.queries()
    want = {c for held in clumps_of({c: r.value >= 400 for c, r in cells.items()}, NEAR4) if sum(cells[c].value % 5 == 0 for c in held) > 1 for c in held if cells[c].value >= 400}
    assert {(r.x, r.y) for r in q["o_r04_patch_tidal_clumps"](spark, SF).collect()} == want
    water = clumps_of({c: r.water for c, r in cells.items()}, NEAR4)
    found = {(r.x, r.y): r.clump for r in q["o_r01_clumps"](spark, SF).collect()}
    assert all(len({found[c] for c in held}) == 1 for held in water) and len(set(found.values())) == len(water)
    filled = {(r.x, r.y): r.water for r in q["o_r01_fill_small_bars"](spark, SF).collect()}
    assert filled == {c: cells[c].water or len(held) < 6 for held in water for c in held}


def test_skeleton(spark):
    left = {(r.x, r.y) for r in Tables(spark, SF).cells.where("water").collect()}
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    while True:
        before = len(left)
        for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            gone = set()
            for x, y in left:
                p = [(x + dx, y + dy) in left for dx, dy in ring]
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                if 2 <= sum(p) <= 6 and turns == 1 and not all(p[k] for k in first) and not all(p[k] for k in second):
                    gone.add((x, y))
            left -= gone
        if len(left) == before:
            break
    assert {(r.x, r.y) for r in registry.queries()["o_r05_skeleton"](spark, SF).collect()} == left


def plain_fill(elev):
    top = {c: e if any((c[0] + a, c[1] + b) not in elev for a, b in NEAR8) else math.inf for c, e in elev.items()}
    while True:
        new = {c: min(top[c], max(elev[c], min(top[c[0] + a, c[1] + b] for a, b in NEAR8 if (c[0] + a, c[1] + b) in elev))) if any((c[0] + a, c[1] + b) in elev for a, b in NEAR8) else top[c] for c in elev}
        if new == top:
            return top
        top = new


def test_depressions_and_sinks(spark, raster):
    q = registry.queries()
    elev = {(r.x, r.y): r.elev for r in Tables(spark, SF).cells.collect() if r.elev is not None}
    assert {(r.x, r.y): r.filled for r in q["o_r10_fill_depressions"](spark, SF).collect()} == plain_fill(elev)
    held = {c: r for c, r in raster.items() if r.elev is not None}
    burnt = {c: 0.0 if r.river or any((c[0] + a, c[1] + b) in held and held[c[0] + a, c[1] + b].river for a, b in NEAR8) else r.elev for c, r in held.items()}
    filled = plain_fill(burnt)
    deep = {c: filled[c] - held[c].elev for c in held if filled[c] - held[c].elev > 1}
    want = {}
    for members in clumps_of({c: 1 for c in deep}, NEAR8):
        volume, ordered = sum(deep[c] for c in members) * 100 / 1000, sorted(held[c].elev for c in members)
        at = 0.02 * (len(ordered) - 1)
        floor = ordered[int(at)] + (at - int(at)) * (ordered[min(int(at) + 1, len(ordered) - 1)] - ordered[int(at)])
        if volume > 0.3:
            want |= {c: min(x * 2**32 + y for x, y in members) for c in members if held[c].elev <= floor}
    holding = {held[c].lake for c in want if held[c].lake is not None}
    want |= {c: 1 for c, r in held.items() if r.lake is not None and (r.lake in holding or r.closed)}
    got = {(r.x, r.y): r.sink for r in q["o_r10_sinks"](spark, SF).collect()}
    assert got == want and len(set(want.values())) > 1


def test_catchments(spark, raster):
    q, table = registry.queries(), {r.reach_id: (r.segment_id, r.catchment_id) for r in Tables(spark, SF).reach_table.collect()}
    want = {c: (r.reach_id, *table[r.reach_id]) for c, r in raster.items() if r.reach_id is not None}
    (x0, y0), (x1, y1) = (min(c[k] for c in raster) for k in (0, 1)), (max(c[k] for c in raster) for k in (0, 1))
    number = max(v for _, v in table.values())
    for held in sorted(clumps_of({c: 1 for c, r in raster.items() if r.land and r.reach_id is None}, NEAR4), key=min):
        if not any(x in (x0, x1) or y in (y0, y1) for x, y in held):
            number += 1
            want |= {c: (None, None, number) for c in held}
    got = {(r.x, r.y): (r.reach_id, r.segment_id, r.catchment_id) for r in q["o_r18_catchments"](spark, SF).collect()}
    assert got == want and number > 10
    sizes = {}
    for reach, _, c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r.catchment_id: (r.is_coastal, r.n_cells) for r in q["o_r18_catchment_table"](spark, SF).collect()} == {c: (int(c > max(v for _, v in table.values())), n) for c, n in sizes.items()}


def test_class_changes(spark):
    rows = {}
    for r in Tables(spark, SF).vertices.collect():
        rows.setdefault(r.id, []).append((r.pos, r.x, r.y, math.floor(r.value / 25)))
    points = []
    for i, v in rows.items():
        v.sort()
        points += [(i, p, x, y, k > 0 and k < len(v) - 1) for k, (p, x, y, c) in enumerate(v) if k in (0, len(v) - 1) or c != v[k - 1][3]]
    groups = {k: {k} for k in range(len(points))}
    for a in range(len(points)):
        for b in range(a):
            if math.dist(points[a][2:4], points[b][2:4]) <= 90 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for k in groups[b]:
                    groups[k] = groups[a]
    want = set()
    for members in {id(g): g for g in groups.values()}.values():
        held = [points[k] for k in members]
        if all(p[4] for p in held):
            want.add(min(held)[:4])
    got = {(r.id, r.pos, r.x, r.y) for r in registry.queries()["o_r13_class_changes"](spark, SF).collect()}
    assert got == want and want


def test_ranked_numbers_without_gaps(spark):
    from potamos.operators.rasters import ranked

    df = spark.range(1000).selectExpr("id * 7 % 1000 AS v").repartition(5)
    assert all(r.number == r.v + 1 for r in ranked(df, "v").collect())
    assert C.cell_id is not None
