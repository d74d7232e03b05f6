"""Fix-points against plain ones, on random graphs, chains, rings and loops."""

import random

import pytest
from weftgraph.operators import iterate
from weftgraph.operators.graph import DependencyGraph


def graph(spark, nodes, pairs):
    edges = spark.createDataFrame([(a, b, "import", 1) for a, b in pairs] or [("", "", "", 0)], "src string, dst string, kind string, count long")
    return DependencyGraph.from_edges(spark.createDataFrame([(n,) for n in nodes], "path string"), edges.where("count > 0"))


def reached(nodes, pairs):
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    while True:
        more = {n: out[n] | {x for m in out[n] for x in out[m]} for n in nodes}
        if more == out:
            return out
        out = more


SHAPES = {
    "empty": (["a", "b"], []),
    "chain": ([f"n{k:02}" for k in range(20)], [(f"n{k:02}", f"n{k + 1:02}") for k in range(19)]),
    "ring": ([f"n{k:02}" for k in range(13)] + ["x"], [(f"n{k:02}", f"n{(k + 1) % 13:02}") for k in range(13)] + [("x", "x")]),
    "rings and tails": ([f"n{k}" for k in range(9)], [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n3"), ("n3", "n4"), ("n4", "n5"), ("n5", "n3"), ("n6", "n0"), ("n5", "n7"), ("n7", "n8")]),
    "a loop by a chain": ([f"n{k}" for k in range(6)], [("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n3", "n0"), ("n0", "n4"), ("n5", "n0")]),
}
for _seed in range(3):
    _r = random.Random(_seed)
    _n = [f"n{k:02}" for k in range(24)]
    SHAPES[f"random {_seed}"] = (_n, list({(_r.choice(_n), _r.choice(_n)) for _ in range(20 + 8 * _seed)}))


@pytest.mark.parametrize("shape", list(SHAPES))
def test_components_and_layers(spark, shape):
    nodes, pairs = SHAPES[shape]
    far = reached(nodes, pairs)
    comp = {n: min([n, *(m for m in far[n] if n in far[m])]) for n in nodes}
    g = graph(spark, nodes, pairs)
    comps = iterate.components(g)
    assert {r["path"]: r["component"] for r in comps.collect()} == comp
    depth = dict.fromkeys(comp.values(), 0)
    for _ in nodes:
        for a, b in pairs:
            if comp[a] != comp[b]:
                depth[comp[b]] = max(depth[comp[b]], depth[comp[a]] + 1)
    assert {r["path"]: r["depth"] for r in iterate.layers(g, comps).collect()} == {n: depth[comp[n]] for n in nodes}
