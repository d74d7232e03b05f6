"""What is reached from files: against plain walks, and in how many tables."""

import pytest
from test_iterate import SHAPES, graph, reached
from weftgraph.operators import iterate


@pytest.mark.parametrize("shape", ["rings and tails", "a loop by a chain", "random 2"])
def test_reach_and_affected(spark, shape):
    nodes, pairs = SHAPES[shape]
    far, near = reached(nodes, pairs), reached(nodes, [(b, a) for a, b in pairs])
    g = graph(spark, nodes, pairs)
    starts = [nodes[2], nodes[-1]]
    want = set().union(*(far[s] for s in starts))
    assert sorted(r["path"] for r in iterate.reach(g, starts).collect()) == sorted(want)
    changed = [nodes[4], "gone"]
    assert sorted(r["path"] for r in iterate.affected(g, changed).collect()) == sorted(near[nodes[4]] | {nodes[4]})


def test_a_long_chain_is_not_walked_node_by_node(spark, monkeypatch):
    # two hundred files, each imported by the next, and a ring beside them
    pairs = [(f"n{i + 1:03}", f"n{i:03}") for i in range(200)] + [("r0", "r1"), ("r1", "r0"), ("r2", "r0")]
    g = graph(spark, sorted({n for p in pairs for n in p}), pairs)
    tables, settle = [], iterate.settle
    monkeypatch.setattr(iterate, "settle", lambda df, name="step": tables.append(name) or settle(df, name))
    assert iterate.affected(g, ["n000"]).count() == 201
    assert len(tables) < 20
