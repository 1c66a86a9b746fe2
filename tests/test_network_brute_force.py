"""Network operators against plain Python, on random graphs and on the tables of their queries."""

import itertools
import random

import pytest

from potamos.operators import cleaning, domains, graph, names, network, solver
from potamos.plans import registry
from potamos.sources.derived import Tables

from .conftest import SF
from .test_graph import lines_of, random_edges, reach


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def ends_of(lines):
    return {i: (a, b) for i, a, b in lines}


def plain_route(lines, own, values, widths):
    """Level by level; lines on and below cycles first, with their node's own value only."""
    proper = {i for i, (a, b) in lines.items() if a != b}
    on = {n for i in proper for n in lines[i] if n in reach([lines[k] for k in proper], n)}
    below = set(on)
    for n in on:
        below |= reach([lines[k] for k in proper], n)
    bad = {i for i, (a, b) in lines.items() if a in below or a == b}
    out = {n: sorted(i for i, (a, _) in lines.items() if a == n) for n in {a for a, _ in lines.values()}}
    share = {i: widths[i] / sum(widths[k] for k in out[lines[i][0]]) for i in lines}
    line_in, line_out = {}, {}
    for i in bad:
        line_in[i] = share[i] * own.get(lines[i][0], 0)
        line_out[i] = line_in[i] + values.get(i, 0)
    left = set(lines) - bad
    while left:
        ready = [i for i in left if not any(lines[k][1] == lines[i][0] for k in left)]
        for i in ready:
            came = sum(line_out[k] for k in lines if lines[k][1] == lines[i][0])
            line_in[i] = share[i] * (came + own.get(lines[i][0], 0))
            line_out[i] = line_in[i] + values.get(i, 0)
        left -= set(ready)
    nodes = {n for e in lines.values() for n in e}
    node_in = {n: sum(line_out[i] for i, (_, b) in lines.items() if b == n) + (own.get(n, 0) if n in out else 0) for n in nodes}
    return line_in, line_out, node_in


@pytest.mark.parametrize("seed", [1, 3])
def test_route(spark, seed):
    rng = random.Random(seed)
    # mostly downhill, so that levels are deep; the third has cycles and self loops
    edges = [tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)]
    if seed == 3:
        edges += [(9, 4), (12, 12), (20, 18)]
    df = lines_of(spark, edges)
    lines = dict(enumerate(edges))
    own, values = {n: float(n % 4) for n in range(25)}, {k: float(k % 3) for k in lines}
    line_in, line_out, node_in = plain_route(lines, own, values, {k: 5 + k % 3 for k in lines})
    routed, nodes = graph.route(df, spark.createDataFrame(list(own.items()), "node long, value double"), spark.createDataFrame(list(values.items()), "id long, value double"))
    got = {i: (a, b) for i, a, b in rows_of(routed, "id", "line_in", "line_out")}
    assert set(got) == set(lines) and all(got[i] == pytest.approx((line_in[i], line_out[i])) for i in lines)
    got = {r.node: (r.node_in, list(r.node_out)) for r in nodes.collect()}
    assert {n: v for n, (v, _) in got.items()} == pytest.approx(node_in)
    for n, (_, out) in got.items():
        assert out == pytest.approx([line_in[i] for i in sorted(lines) if lines[i][0] == n])


def test_route_by_hand(spark):
    lines = lines_of(spark, [(1, 2), (2, 3)])
    own = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "node long, value double")
    assert {r.node: r.node_in for r in graph.route(lines, own)[1].collect()} == {1: 1.0, 2: 2.0, 3: 2.0}
    loop = lines_of(spark, [(1, 2), (2, 3), (3, 2), (3, 4)])
    assert {r.id: r.line_out for r in graph.route(loop, own)[0].collect()} == {0: 1.0, 1: 1.0, 2: pytest.approx(7 / 12), 3: pytest.approx(5 / 12)}


def plain_clean(lines, length, facts, factor, lake_factor, min_accum, rounds=None):
    left = {i for i, (a, b) in lines.items() if a != b}
    visited, k = set(), 0
    while rounds is None or k < rounds:
        k += 1
        at = {}
        for i in left:
            for n in lines[i]:
                at.setdefault(n, []).append(i)
        tips = {n for n, held in at.items() if len(held) == 1 and n not in visited}
        short = {}
        for i in left:
            mine = [n for n in lines[i] if n in tips]
            if len(mine) != 1:
                continue
            there = [n for n in lines[i] if n not in visited]
            wide = min(there, key=lambda n: (-facts[n]["width"], n))
            least = facts[wide]["width"]
            if length[i] < least * factor or (all(facts[n]["lake"] for n in there) and length[i] < least * lake_factor):
                short[i] = (wide, any(facts[n]["outlet"] for n in there), mine[0])
        for wide in {w for w, o, _ in short.values() if o}:
            del short[min((i for i, (w, o, _) in short.items() if w == wide and o), key=lambda i: (length[i], i))]
        for wide in {w for w, _, _ in short.values()}:
            mine = [i for i, (w, _, _) in short.items() if w == wide]
            if len(mine) > 1:
                del short[min(mine, key=lambda i: (-length[i], i))]
        gone = {i for i, (_, _, tip) in short.items() if not (facts[tip]["darea"] >= min_accum and not facts[tip]["lake"])}
        if not gone:
            break
        left -= gone
        visited |= tips
    return left


def clean_input(spark, edges, seed):
    rng = random.Random(seed)
    lines = dict(enumerate(edges))
    length = {i: float(rng.randint(1, 60)) for i in lines}
    facts = {n: {"width": float(rng.randint(5, 40)), "lake": rng.randint(0, 1), "darea": float(rng.randint(0, 120)), "outlet": int(rng.random() < 0.15)} for e in edges for n in e}
    df = spark.createDataFrame([(i, a, b, length[i], 1.0) for i, (a, b) in lines.items()], "id long, start_node long, end_node long, length double, width double")
    nodes = spark.createDataFrame([(n, f["width"], f["lake"], f["darea"], f["outlet"]) for n, f in facts.items()], "id long, river_width double, is_lake int, darea double, is_outlet int")
    return lines, length, facts, df, nodes


@pytest.mark.parametrize("seed", [11, 12])
def test_clean_network(spark, seed):
    rng = random.Random(seed)
    edges = [(n, rng.randrange(max(1, n - 6), n + 1) if rng.random() < 0.9 else n) for n in range(2, 45)] + [(3, 3)]
    lines, length, facts, df, nodes = clean_input(spark, edges, seed)
    for rounds in (1, None):
        want = plain_clean(lines, length, facts, 1.0, 2.0, 100.0, rounds)
        assert {r.id for r in cleaning.clean_network(df, nodes, min_accum=100.0, rounds=rounds).collect()} == want
    assert len(want) < len(edges) - 3


def test_clean_network_by_hand(spark):
    """Of two short dangles at a node the longest stays, for good; a short outlet stays even alone."""
    lines = spark.createDataFrame([(1, 1, 2, 500.0, 1.0), (2, 2, 3, 500.0, 1.0), (3, 9, 2, 5.0, 1.0), (4, 8, 2, 7.0, 1.0), (5, 3, 7, 4.0, 1.0), (6, 3, 6, 900.0, 1.0)], "id long, start_node long, end_node long, length double, width double")
    width = {n: 50.0 for n in (1, 2, 3, 6)} | {7: 10.0, 8: 10.0, 9: 10.0}
    nodes = spark.createDataFrame([(n, w, 0, 1.0, int(n == 7)) for n, w in width.items()], "id long, river_width double, is_lake int, darea double, is_outlet int")
    assert sorted(r.id for r in cleaning.clean_network(lines, nodes).collect()) == [1, 2, 4, 5, 6]


def test_query_clean_network(spark):
    t = Tables(spark, SF)
    raw = t.loose_lines.collect()
    lines, length = {r.id: (r.start_node, r.end_node) for r in raw}, {r.id: r.length for r in raw}
    facts = {r.id: {"width": r.river_width, "lake": r.is_lake, "darea": r.darea, "outlet": r.is_outlet} for r in t.nodes.collect()}
    got = {r.id for r in registry.queries()["o_g01_clean_network"](spark, SF).collect()}
    assert got == plain_clean(lines, length, facts, 4.0, 8.0, 900.0) and len(got) < len(lines)


def plain_split(lines, cuts):
    degree = {}
    for i, (a, b) in lines.items():
        for n in (a, b):
            degree.setdefault(n, []).append(i)
    beside = {n for n, held in degree.items() if len(held) == 1 for n2 in lines[held[0]] for n in (n2,)}
    out = {}
    for c in cuts:
        if c in beside or len(degree.get(c, ())) < 2:
            continue
        rest = [e for i, e in lines.items() if c not in e]
        both = rest + [(b, a) for a, b in rest]
        present = {n for e in rest for n in e}
        found = []
        for i in degree[c]:
            far = lines[i][0] if lines[i][1] == c else lines[i][1]
            found.append((len(reach(both, far) | {far}) if far in present else -1, i))
        out[c] = min(found)
    return out


@pytest.mark.parametrize("seed", [21, 22])
def test_split_interbasin(spark, seed):
    edges = [e for e in random_edges(seed, 22, 30) if e[0] != e[1]]
    lines = dict(enumerate(edges))
    cuts = random.Random(seed).sample(range(22), 9)
    got = cleaning.split_interbasin(lines_of(spark, edges), spark.createDataFrame([(c,) for c in cuts], "id long"))
    assert {r.node: (r.n_nodes, r.id) for r in got.collect()} == plain_split(lines, cuts)


def test_query_split_interbasin(spark):
    t = Tables(spark, SF)
    lines = {r.id: (r.start_node, r.end_node) for r in t.loose_lines.collect()}
    cuts = [r.id for r in t.nodes.where("type = 'interbasin'").collect()]
    assert {r.node: (r.n_nodes, r.id) for r in registry.queries()["o_g13_split_interbasin"](spark, SF).collect()} == plain_split(lines, cuts)


def plain_prune(lines, single, outlet):
    left, gone = dict(lines), {}
    k = 0
    while True:
        k += 1
        degree = {}
        for i, e in left.items():
            for n in e:
                degree.setdefault(n, []).append(i)
        now = {}
        for n, held in degree.items():
            if len(held) == 1 and single.get(n) and not outlet.get(n):
                a, b = left[held[0]]
                if single.get(b if n == a else a):
                    now.setdefault(held[0], set()).add(n)
        if not now:
            break
        for i, tips in now.items():
            gone[i] = (k, left[i][0] not in tips)
            del left[i]
    count = {n: sum(e.count(n) for e in left.values()) for e in lines.values() for n in e}
    whole = {i: e for i, e in left.items() if min(e) > 0}
    still = {n for e in whole.values() for n in e}
    nodes = {n: (c, int(c == 1 and not outlet.get(n))) for n, c in count.items() if c and n in single and n in still}
    return whole, gone, nodes


def test_query_prune_single_flow(spark):
    t = Tables(spark, SF)
    lines = {r.id: (r.start_node, r.end_node) for r in t.messy_lines.collect()}
    facts = t.nodes.collect()
    whole, gone, nodes = plain_prune(lines, {r.id: r.river_width < 350 for r in facts}, {r.id: r.is_outlet for r in facts})
    q = registry.queries()
    assert {r.id: (r["round"], r.reversed) for r in q["o_g16_peel_leaves"](spark, SF).collect()} == gone and gone
    assert {r.id: (r.n_lines, r.inlet) for r in q["o_g16_pruned_nodes"](spark, SF).collect()} == nodes
    left = solver.prune_single_flow(t.messy_lines, t.nodes.selectExpr("id", "int(river_width < 350) AS single_flow", "is_outlet AS outlet"))[0]
    assert {r.id for r in left.collect()} == set(whole)


def plain_paths(near, ends, longest):
    found = set()
    for s, e in itertools.combinations(sorted(ends), 2):
        work = [(s,)]
        while work:
            path = work.pop()
            if path[-1] == e:
                found |= set(path)
                continue
            if len(path) <= longest:
                work += [(*path, n) for n in near.get(path[-1], ()) if n not in path]
    return found


def plain_fill(lines, longest, weight):
    """``lines``: id -> (a, b, name, comp)."""
    out = {i: n for i, (_, _, n, _) in lines.items()}
    groups = {}
    for i, (_, _, n, c) in lines.items():
        if n is not None:
            groups.setdefault((c, n), []).append(i)
    order = sorted(groups, key=lambda g: (-sum(weight[i] for i in groups[g]), g[1], g[0]))
    for comp, name in order:
        named = {n for i in groups[comp, name] for n in lines[i][:2]}
        sparse = {n for n in named if any(n in (a, b) and (b if n == a else a) not in named for a, b, _, _ in lines.values())}
        blank = {i for i, (_, _, _, c) in lines.items() if out[i] is None and c == comp}
        nodes = {n for i in blank for n in lines[i][:2]}
        near = {}
        for a, b, _, _ in lines.values():
            if a in nodes and b in nodes and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        on = plain_paths(near, sparse & nodes, longest)
        for i in blank:
            if lines[i][0] in on and lines[i][1] in on:
                out[i] = name
    return {i: n for i, n in out.items() if lines[i][2] is None and n is not None}


@pytest.mark.parametrize("seed", [31, 32])
def test_fill_names(spark, seed):
    rng = random.Random(seed)
    edges = [e for e in random_edges(seed, 20, 28) if e[0] != e[1]]
    lines = {i: (a, b, rng.choice((None, None, "n1", "n2")), 0) for i, (a, b) in enumerate(edges)}
    weight = {i: float(rng.randint(1, 9)) for i in lines}
    df = spark.createDataFrame([(i, *x, weight[i]) for i, x in lines.items()], "id long, start_node long, end_node long, name string, comp long, w double")
    for longest in (2, 5):
        assert dict(rows_of(names.fill_names(df, longest, "w"), "id", "name")) == plain_fill(lines, longest, weight)
    assert dict(rows_of(names.fill_names(df, 5), "id", "name")) == plain_fill(lines, 5, {i: 1 for i in lines})


def test_query_fill_names(spark):
    raw = Tables(spark, SF).named_lines.collect()
    lines = {r.id: (r.start_node, r.end_node, r.name, r.comp) for r in raw}
    got = {r.id: r.name for r in registry.queries()["o_g26_fill_names"](spark, SF).collect()}
    assert got == plain_fill(lines, 4, {r.id: r.length for r in raw}) and got


def plain_allocate(nodes, skip):
    """``nodes``: (domain, comp) -> set of places."""
    size = {k: len(v) for k, v in nodes.items()}
    ignore, kept = {}, set()
    for d in sorted({d for d, _ in nodes}):
        for (dom, c), places in nodes.items():
            if dom != d or (skip and c in ignore.get(d, ())):
                continue
        mine = [c for dom, c in nodes if dom == d and not (skip and c in ignore.get(d, ()))]
        given = {}
        for c in mine:
            met = {}
            for (o, oc), places in nodes.items():
                if o != d and oc not in ignore.get(o, ()) and places & nodes[d, c]:
                    met.setdefault(o, []).append(oc)
            if not met:
                kept.add((d, c))
            for o, found in met.items():
                if len(found) > 1:
                    kept.add((d, c))
                elif size[d, c] >= size[o, found[0]]:
                    kept.add((d, c))
                    given.setdefault(o, set()).add(found[0])
        for o, found in given.items():
            ignore.setdefault(o, set()).update(found)
    return kept


@pytest.mark.parametrize("seed, skip", [(41, True), (42, True), (42, False)])
def test_allocate_components(spark, seed, skip):
    rng = random.Random(seed)
    nodes = {(d, c): {(rng.randrange(30), 0) for _ in range(rng.randint(1, 6))} for d in range(4) for c in range(5)}
    df = spark.createDataFrame([(d, c, x, y) for (d, c), held in nodes.items() for x, y in held], "domain long, comp long, x long, y long")
    assert set(rows_of(domains.allocate_components(df, skip), "domain", "comp")) == plain_allocate(nodes, skip)


def test_query_allocate_components(spark):
    nodes = {}
    for r in Tables(spark, SF).shared_nodes.collect():
        nodes.setdefault((r.domain, r.comp), []).append((r.x, r.y))
    sizes = {k: len(v) for k, v in nodes.items()}
    got = set(rows_of(registry.queries()["o_g30_allocate_components"](spark, SF), "domain", "comp"))
    assert got <= set(sizes) and all(k in got for k, v in nodes.items() if not any(o[0] != k[0] and set(w) & set(v) for o, w in nodes.items()))


def test_snap_ends_by_hand(spark):
    lines = spark.createDataFrame([(1, 1, 2, 900.0, 1.0), (2, 2, 3, 900.0, 1.0), (3, 3, 4, 900.0, 1.0), (4, 4, 5, 900.0, 1.0), (5, 10, 11, 50.0, 1.0)], "id long, start_node long, end_node long, length double, width double")
    at = {1: (0, 0), 2: (900, 0), 3: (900, 900), 4: (0, 900), 5: (0, 100), 10: (0, -80), 11: (0, -130)}
    nodes = spark.createDataFrame([(n, float(x), float(y), 30.0, True) for n, (x, y) in at.items()], "id long, x double, y double, river_width double, is_end boolean")
    got = {(r.a, r.b): (r.dist, r.loop, r.n_between) for r in cleaning.snap_ends(lines, nodes, 10.0, 150.0).collect()}
    assert got == {(1, 10): (80.0, None, None), (1, 5): (100.0, 3700.0, 3)} or got == {(1, 10): (80.0, None, None), (1, 5): (100.0, 3700.0, 3), (10, 11): (50.0, None, None)}
    assert (1, 5) not in {(r.a, r.b) for r in cleaning.snap_ends(lines, nodes, 10.0, 150.0, min_loop=4000.0).collect()}
    assert (1, 5) not in {(r.a, r.b) for r in cleaning.snap_ends(lines, nodes, 10.0, 150.0, factor=100.0).collect()}


def test_fix_links_raise(spark):
    rows = [(1, 10, 20, 0.95, 5.0, 355.0 - 355.0 + 9.0), (2, 11, 21, 0.95, 5.0, 183.0), (3, 12, 22, 0.5, 0.0, 90.0)]
    schema = "line long, start_node long, end_node long, share double, azimuth double, fix_azimuth double"
    assert sorted(map(tuple, network.fix_links(spark.createDataFrame(rows, schema)).collect())) == [(1, 10), (2, 21)]
    with pytest.raises(Exception, match="line 4 crosses"):
        network.fix_links(spark.createDataFrame([*rows, (4, 1, 2, 0.99, 0.0, 90.0)], schema)).collect()


def boxes_of(spark, boxes):
    return spark.createDataFrame([(i, 1, *map(float, b), float(a)) for i, (b, a) in boxes.items()], "id long, region long, minx double, miny double, maxx double, maxy double, area double")


def test_domains_by_hand(spark):
    # 1 and 2 make a full square, 3 lies inside it, 4 is far off, 5 meets 4
    df = boxes_of(spark, {1: ((0, 0, 10, 20), 180), 2: ((10, 0, 20, 20), 180), 3: ((4, 4, 6, 6), 4), 4: ((50, 0, 60, 10), 90), 5: ((60, 0, 90, 10), 290)})
    merged = dict(rows_of(domains.agglomerate(df, 400.0), "id", "domain"))
    assert merged[1] == merged[2] == merged[3] == 1 and merged[4] == merged[5] == 4
    assert dict(rows_of(domains.agglomerate(df, 250.0), "id", "domain")) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert dict(rows_of(domains.agglomerate(df, 400.0, ("compactness", "area_ratio"), ignore_area=10.0), "id", "domain")) == {1: 1, 2: 1, 4: 4, 5: 4}
    with pytest.raises(ValueError):
        domains.agglomerate(df, 1.0, ("beauty",))
    grown = dict(rows_of(domains.grow_domains(df, 400.0, "within_distance", max_distance=5.0), "id", "domain"))
    assert grown == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert dict(rows_of(domains.grow_domains(df, 5000.0, "largest", max_distance=5.0, min_compactness=0.9), "id", "domain")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert dict(rows_of(domains.grow_domains(df, 400.0, "most_compact"), "id", "domain")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


@pytest.mark.parametrize("name", ["o_g31_agglomerate_domains", "o_g31_agglomerate_by_product", "o_g32_grow_within_distance", "o_g32_grow_largest", "o_g32_grow_most_compact"])
def test_query_domains_keep_their_size(spark, name):
    basins = {r.id: r for r in Tables(spark, SF).basins.collect()}
    groups = {}
    for i, d in rows_of(registry.queries()[name](spark, SF), "id", "domain"):
        groups.setdefault(d, []).append(basins[i])
    assert sorted(b.id for g in groups.values() for b in g) == sorted(basins)
    for held in groups.values():
        size = (max(b.maxx for b in held) - min(b.minx for b in held)) * (max(b.maxy for b in held) - min(b.miny for b in held))
        assert len({b.region for b in held}) == 1 and size <= 900
    assert len(groups) < len(basins)
