"""Components: rounds of trees, and random graphs against a union-find."""

import random

from chronoflow.operators import graph


def test_a_tree_of_two_levels_takes_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: written.append(1) or cut(df))
    # Lines sort before their orders, so their smallest neighbour is no way up for them.
    rows = [(f"c{i % 3}", f"o{i}") for i in range(12)] + [(f"o{i}", f"l{i}-{k}") for i in range(12) for k in range(4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "s string, d string")).collect()}
    assert got == {x: f"c{int(x[1:].split('-')[0]) % 3}" for row in rows for x in row}
    assert len(written) == 4  # the edges, then a round's neighbours, moves and edges that are left


def test_random_graphs(spark):
    draw = random.Random(3)
    for nodes, edges in ((40, 20), (60, 55), (30, 90), (1, 1)):
        rows = [(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(edges)]
        rows += rows[:3]
        of = {x: x for row in rows for x in row}
        for _ in of:
            for a, b in rows:
                of[a] = of[b] = min(of[a], of[b])
        got = [tuple(r) for r in graph.components(spark.createDataFrame(rows, "s string, d string")).collect()]
        assert sorted(got) == sorted(of.items())
    assert graph.components(spark.createDataFrame([], "s string, d string")).count() == 0
