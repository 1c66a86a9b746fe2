"""Deep networks, by hand: runs of lines without a junction, and what cycles leave."""

import os

from potamos.operators import cells, graph, lineage

from .test_graph import lines_of


def test_deep_networks_keep_their_lines(spark):
    chain = lines_of(spark, [(k, k + 1) for k in range(5)] + [(90, 91), (91, 90)])
    assert {r.id: r.level for r in graph.levels(chain).collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: -1, 6: -1}
    flow = spark.createDataFrame([(k, 0, k + 1 if k < 4 else None, 0 if k < 4 else None) for k in range(5)], "x long, y long, to_x long, to_y long")
    assert {r.x: r.n_cells for r in cells.accumulate(flow).collect()} == {k: k + 1 for k in range(5)}
    values = spark.createDataFrame([(0, 2.0)], "node long, value double")
    # lines on a cycle are routed too, with their node's own value
    assert {r.id: r.line_out for r in graph.route(chain, values)[0].collect()} == {k: 2.0 if k < 5 else 0.0 for k in range(7)}
    peeled = graph.peel_leaves(chain.where("id < 5"), spark.createDataFrame([(k,) for k in range(5)], "node long"))
    assert {r.id: r["round"] for r in peeled.collect()} == {0: 1, 1: 2, 2: 3, 3: 4}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    real = lineage.Rounds.add
    monkeypatch.setattr(lineage.Rounds, "add", lambda self, df: made.append(1) or real(self, df))
    edges = [(k, k + 1) for k in range(400)] + [(1000, 200), (1001, 200), (400, 2000), (400, 2001)]
    found = {r.id: r.level for r in graph.levels(lines_of(spark, edges)).collect()}
    assert all(found[k] == k + 1 for k in range(400)) and found[400] == found[401] == 1 and found[402] == found[403] == 401
    assert len(made) <= 6
    out, nodes = graph.route(lines_of(spark, edges), spark.range(3000).selectExpr("id AS node", "1.0D AS value"))
    at = {r.node: r.node_in for r in nodes.collect()}
    assert at[199] == 200 and at[200] == 203 and at[400] == 403 and abs(at[2000] + at[2001] - 403) < 1e-9


def test_settled_tables_go_when_they_are_spent(spark):
    folder = lineage.shared_dir(spark).removeprefix("file:")
    first = lineage.settle(spark.range(5))
    held = set(os.listdir(folder))
    second = lineage.settle(first.selectExpr("id + 1 AS id"), first)
    assert second.count() == 5 and len(set(os.listdir(folder)) - held) == 1 and len(held - set(os.listdir(folder))) == 1
    lineage.release(second, spark.range(3), None)
    assert len(os.listdir(folder)) == len(held) - 1
