"""Clusters of texts that have a line in common and little else, and of copies that differ much: no work for all pairs."""

from fractions import Fraction

import numpy as np
import pytest
from test_operators import brute_components
from weftgraph.llm import ngram_join


@pytest.mark.parametrize("passes", [1, 3])
def test_texts_that_share_a_line_are_not_joined_in_pairs(spark, monkeypatch, passes):
    monkeypatch.setattr(ngram_join, "LOOSE", 20, raising=False)
    r = np.random.default_rng(21)
    line = " ".join(f"line{x}" for x in range(24))
    rows = []
    for k in range(150):
        own = [f"w{x}" for x in r.integers(0, 100_000, 30)]
        rows.append((k, " ".join(own) + "\n" + line))
        if k % 10 == 0:  # a near copy, and the same without the line, which is none
            rows += [(1000 + k, " ".join([*own, "more"]) + "\n" + line), (2000 + k, " ".join(own))]
    if passes > 1:
        elements = sum(len(ngram_join.shingle_set(t, 5)) for _, t in rows)
        monkeypatch.setattr(ngram_join, "ELEMENTS", elements // passes, raising=False)
    largest, in_tasks = [], ngram_join._join_in_tasks

    def seen(members, *a):
        largest.append(max((x["count"] for x in members.groupBy("grp").count().collect()), default=0))
        return in_tasks(members, *a)

    monkeypatch.setattr(ngram_join, "_join_in_tasks", seen)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_components(rows, 5, Fraction(4, 5))
    assert sum(x["component_id"] != x["doc_id"] for x in got) == 15
    assert max(largest) < 20


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)])
def test_tightened_clusters_hold_all_links(spark, t):
    r = np.random.default_rng(22)
    sets = []
    for base in (r.integers(-(2**63), 2**63 - 1, n) for n in (1, 2, 7, 19, 20, 21, 60, 200)):
        for _ in range(25):  # of many sizes, about as far apart as a link allows
            kept = base[: max(1, len(base) - r.integers(0, int(len(base) * (1 - t)) + 2))]
            sets.append(np.unique(np.append(kept, r.integers(-(2**63), 2**63 - 1, r.integers(0, int(len(base) * (1 - t)) + 2)))))
    members = spark.createDataFrame([(1, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "grp long, node long, s binary")
    grp = {x["node"]: x["grp"] for x in ngram_join._tightened(members, t).collect()}
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if both >= t * (len(a) + len(b) - both):
                links += 1
                assert grp[i] == grp[j]
    assert links > 100 and len(set(grp.values())) >= 8


def test_overlapping_regions_are_not_walked_down():
    r = np.random.default_rng(23)
    template = [f"t{x}" for x in range(400)]
    sets = []
    for k in range(500):  # half of these are too far from all others
        words = list(template)
        for at in r.choice(400, k % 40, replace=False):
            words[at] = f"x{r.integers(0, 10_000)}"
        sets.append(ngram_join.shingle_set(" ".join(words), 5))
    region, met = ngram_join.Region(sets, Fraction(4, 5)), []
    shared = region.shared
    region.shared = lambda p, ids: met.append(len(ids)) or shared(p, ids)
    region.join(np.arange(len(sets)))
    label = region.label(np.arange(len(sets)))
    for i in range(0, 500, 7):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 5 * both < 4 * (len(sets[i]) + len(sets[j]) - both) or label[i] == label[j]
    assert sum(met) < len(sets) ** 2 / 4
