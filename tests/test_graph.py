"""Graph operators against brute force on small random networks."""

import random

import pytest

from potamos.operators import cells, cleaning, graph, network
from potamos.operators.components import connected_components


def lines_of(spark, edges):
    return spark.createDataFrame([(k, a, b, float(10 + k), float(5 + k % 3)) for k, (a, b) in enumerate(edges)], "id long, start_node long, end_node long, length double, width double")


def random_edges(seed, n=14, m=18):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def reach(edges, a):
    seen, work = set(), [a]
    while work:
        x = work.pop()
        for s, e in edges:
            if s == x and e not in seen:
                seen.add(e)
                work.append(e)
    return seen


def brute_components(edges):
    both = edges + [(b, a) for a, b in edges]
    return {n: min(reach(both, n) | {n}) for e in edges for n in e}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = random_edges(seed, 30, 22)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute_components(edges)


def test_components_long_chain_and_empty(spark):
    df = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in connected_components(df).collect()} == {0}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_bridges(spark, seed):
    edges = random_edges(seed, 12, 15)
    want = set()
    for k, (a, b) in enumerate(edges):
        rest = edges[:k] + edges[k + 1 :]
        if a != b and b not in reach(rest + [(y, x) for x, y in rest], a):
            want.add(k)
    assert {r.id for r in graph.bridges(lines_of(spark, edges)).collect()} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_strong_components(spark, seed):
    edges = random_edges(seed)
    nodes = {n for e in edges for n in e}
    far = {n: reach(edges, n) for n in nodes}
    want = {n: min(x for x in far[n] if n in far[x]) for n in nodes if n in far[n]}
    assert {r.node: r.scc for r in graph.strong_components(lines_of(spark, edges)).collect()} == want


def test_levels_stay_minus_one_at_cycles(spark):
    found = {r.id: r.level for r in graph.levels(lines_of(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (9, 9), (8, 2)])).collect()}
    assert found == {0: 1, 1: -1, 2: -1, 3: -1, 4: -1, 5: 1}


def test_route_conserves_mass(spark):
    lines = lines_of(spark, [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6)])
    own = spark.createDataFrame([(n, 1.0) for n in range(1, 7)], "node long, value double")
    _, nodes = graph.route(lines, own)
    assert {r.node: r.node_in for r in nodes.collect()}[6] == pytest.approx(5.0)


def test_shortest_paths(spark):
    edges = random_edges(7)
    found = {(r.source, r.node): r.distance for r in graph.shortest_paths(lines_of(spark, edges), spark.createDataFrame([(edges[0][0],)], "node long")).collect()}
    best = {edges[0][0]: 0.0}
    for _ in range(20):
        for k, (a, b) in enumerate(edges):
            for x, y in ((a, b), (b, a)):
                if x in best:
                    best[y] = min(best.get(y, 1e9), best[x] + 10 + k)
    assert {n: d for (_, n), d in found.items()} == best


def test_follow_leaves_out_closed_chains(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7), (5, 99)], "node long, next long")
    assert {(r.node, r.root, r.steps) for r in graph.follow(p).collect()} == {(1, 3, 2), (2, 3, 1), (3, 3, 0), (5, 99, 1)}


def test_peel_leaves(spark):
    lines = lines_of(spark, [(1, 2), (2, 3), (3, 4)])
    may = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {(r.id, r.round) for r in graph.peel_leaves(lines, may).collect()} == {(0, 1), (1, 2)}


def test_cycles_removed(spark):
    lines = lines_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (1, 2), (5, 5)])
    nodes = spark.createDataFrame([(n, float(n)) for n in range(1, 6)], "id long, darea double")
    left = cleaning.remove_cycles(lines, nodes)
    assert graph.bridges(left).count() == left.count() == 3


def test_clean_network_drops_short_dangle(spark):
    lines = spark.createDataFrame([(1, 1, 2, 500.0, 1.0), (2, 2, 3, 500.0, 1.0), (3, 9, 2, 5.0, 1.0), (4, 2, 2, 5.0, 1.0)], "id long, start_node long, end_node long, length double, width double")
    nodes = spark.createDataFrame([(n, 100.0, 0, 1.0, int(n == 3)) for n in (1, 2, 3, 9)], "id long, river_width double, is_lake int, darea double, is_outlet int")
    assert sorted(r.id for r in cleaning.clean_network(lines, nodes).collect()) == [1, 2]


def test_short_dangles_and_topology(spark):
    lines = lines_of(spark, [(1, 3), (2, 3), (3, 4), (4, 5)])
    nodes = spark.createDataFrame([(n, int(n == 5)) for n in range(1, 6)], "id long, is_outlet int")
    assert [r.id for r in network.short_dangles(lines, nodes, 100.0).collect()] == [0]
    ids = {r.id: (r.upstream_line_ids, r.downstream_line_ids) for r in network.topology_ids(lines).collect()}
    assert ids[2] == ("0,1", "3") and ids[0] == ("", "2")


def test_thinning_keeps_connection(spark):
    block = spark.createDataFrame([(x, y) for x in range(12) for y in range(3)], "x long, y long")
    left = cells.thin(block)
    assert 0 < left.count() < 36
    assert connected_components(cells.to_lines(left).selectExpr("start_node AS src", "end_node AS dst")).select("component").distinct().count() == 1


def test_depressions_fill_to_their_rim(spark):
    grid = [(x, y, 1.0 if (x, y) == (2, 2) else 5.0 if 0 < x < 4 and 0 < y < 4 else 7.0) for x in range(5) for y in range(5)]
    filled = {(r.x, r.y): r.filled for r in cells.fill_depressions(spark.createDataFrame(grid, "x long, y long, elev double")).collect()}
    assert filled[2, 2] == 7.0 and filled[0, 0] == 7.0


@pytest.mark.parametrize("diagonal", [False, True])
def test_clumps_and_small_bars(spark, diagonal):
    rng = random.Random(4)
    water = {(x, y): rng.random() < 0.55 for x in range(9) for y in range(7)}
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) and (diagonal or not dx * dy)]
    edges = [((x, y), (x + dx, y + dy)) for (x, y), w in water.items() for dx, dy in near if water.get((x + dx, y + dy)) == w]
    whole = {c: {c} | reach(edges, c) for c in water}
    grid = spark.createDataFrame([(x, y, w) for (x, y), w in water.items()], "x long, y long, water boolean")
    found = {(r.x, r.y): r.clump for r in cells.clumps(grid, ["water"], diagonal).collect()}
    assert found == {c: found[min(members)] for c, members in whole.items()}
    assert len(set(found.values())) == len({min(m) for m in whole.values()})
    if not diagonal:
        filled = {(r.x, r.y): r.water for r in cells.fill_small(grid, "water", 6).collect()}
        assert filled == {c: w or len(whole[c]) < 6 for c, w in water.items()}
