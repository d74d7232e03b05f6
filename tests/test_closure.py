"""All connected pairs: each once, and most of them never on disk."""

import pytest
from pyspark.sql import functions as F
from test_iterate import SHAPES, reached
from weftgraph.operators import iterate


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_all_pairs(spark, shape):
    nodes, pairs = SHAPES[shape]
    want = sorted((a, b) for a, far in reached(nodes, pairs).items() for b in far)
    assert sorted(tuple(r) for r in iterate.all_reached(frame(spark, pairs)).collect()) == want
    known = iterate.closure(frame(spark, pairs)).collect()
    assert sorted((r["src"], r["dst"]) for r in known) == want


def test_rings_loops_and_tails(spark):
    # a ring of nodes with one edge out and a tail to it; a loop on itself; a top that is on its own way; two ways to one end
    pairs = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("t", "r1"), ("s", "s"), ("u", "s"), ("c", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "y"), ("x", "z"), ("y", "w"), ("z", "w"), ("w", "e"), ("x", "t")]
    nodes = sorted({n for p in pairs for n in p})
    want = sorted((a, b) for a, far in reached(nodes, pairs).items() for b in far)
    assert sorted(tuple(r) for r in iterate.all_reached(frame(spark, pairs)).collect()) == want


def test_pairs_below_a_top_are_not_written(spark, monkeypatch):
    # three hundred files hang on one that starts two ways of fifty files
    pairs = [(f"f{i:03}", "top") for i in range(300)] + [("top", f"{w}00") for w in "ab"] + [(f"{w}{i:02}", f"{w}{i + 1:02}") for w in "ab" for i in range(49)]
    written, settled = [], iterate.settled

    def seen(df, name="step"):
        out = settled(df, name)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(iterate, "settled", seen)
    monkeypatch.setattr(iterate, "settle", lambda df, name="step": seen(df, name)[0])
    found = iterate.all_reached(frame(spark, pairs))
    assert found.count() == found.distinct().count() == 300 * 101 + 100 + 2 * 49 * 50 // 2
    assert max(written) < 4000


def test_a_pair_is_met_once_a_way(spark, monkeypatch):
    # a chain of 130: a pair far apart could be cut in many places
    met, group = [], iterate.settled

    def seen(df, name="step"):
        joins = df._jdf.queryExecution().optimizedPlan().toString()
        out = group(df, name)
        met.append(("Join" in joins, out[0].count()))
        return out

    monkeypatch.setattr(iterate, "settled", seen)
    far = iterate.closure(frame(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(130)]))
    assert far.agg(F.count(F.lit(1)), F.max("dist")).first() == (130 * 131 // 2, 130)
    assert [n for _, n in met] == [sum(131 - d for d in range(1, min(2**k, 130) + 1)) for k in range(9)]
