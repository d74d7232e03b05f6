"""Operator 10: exact Jaccard join of word n-gram sets in metric space.

Jaccard distance is a metric, and two documents link when theirs is at most EPS = 1 - threshold. Documents with
equal sets are one node. The join has two levels.

1. Nodes that can have a partner are found without comparing pairs. In sets of a size class that link at most H
   elements differ (the bound on the symmetric difference that the threshold implies), so at most H slices of the
   hash space differ too. The space is cut into more slices than that, and a node names those of its slices that
   hold a few elements or more, as empty or single ones tie what has nothing else in common; it is sure to share a
   name with each partner if it names more than H. If it doesn't, it names slices of a finer split as well, and at
   last elements. Names that several nodes share elect the least of them as a pivot, and each is tied to it. Linked
   nodes thus always end in one cluster. A line that many texts hold ties them all, and such a cluster grows faster
   than the table; so in clusters of more than LOOSE nodes ties are made anew, by the elements that are rarest in the
   cluster: sets that have at least k elements in common share one of the rarest |s| - k + 1 of each of them.
2. Clusters are joined by pivots. In a region some nodes are pivots; every node goes to the Voronoi region of its
   nearest pivot, at distance r, and by the triangle inequality also to each region whose pivot is no farther than
   r + 2 * EPS: two linked nodes share the region of the nearest pivot of either. Regions are joined the same way
   in their turn until they are small or stop shrinking; then distances are taken exactly, pair by pair within the
   windows |d(x, p) - d(y, p)| <= EPS, sparing pairs that known links connect. Clusters of at most IN_TASK nodes
   are joined in a task, several clusters after another; larger ones are split over the cluster by the same rule,
   and where that fails to shrink them, in pairs of blocks, so no group has to fit in one task.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; n-grams are 64-bit hashes of n words, and a set is known by
a 64-bit sum of its mixed hashes. A text of fewer words is one n-gram; a null or wordless text has an empty set and
links with nothing. Repeated rows and equal texts are one node. A null doc_id is never a component's id: such rows
get the least id of their component, or null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, materialise, mix, text_of, written

_U = np.uint64
IN_TASK = 4_000
LOOSE = 500
LEAF = 48
CLASS_RATIO = 1.5
#: Size classes of loose clusters: the nearer the sizes of partners, the more they have in common.
FINE_RATIO = 1.05
#: The names of slices are brought together in so many passes, each over its share of the name space: all are, but
#: the shuffle files of one pass only are on disk at a time.
PASSES = 4
#: How often the sets of large clusters may be in shuffle files of one pass.
SETS_TWICE = 2
#: Elements of loose clusters that are counted in one pass, over its share of the hash space.
ELEMENTS = 200_000_000


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    # hashed anew each time: a table of known words is slower than the hash, and stays in the worker for all later stages
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i] * _U(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(h)


def most_differences(total: int, threshold: Fraction) -> int:
    """The most elements by which linked sets of `total` elements together can differ."""
    return int(total * (1 - threshold) / (1 + threshold))


def classes_of(size: int, threshold: Fraction) -> list[int]:
    """Size classes in which a set of this size can meet a partner: its own and those of larger partners."""
    top = lambda c: int(CLASS_RATIO ** (c + 1))  # noqa: E731  the largest size of class c
    own = 0
    while top(own) < size:
        own += 1
    out = [own]
    while int(size / threshold) > top(out[-1]):
        out.append(out[-1] + 1)
    return out


def splits(largest: int, threshold: Fraction) -> list[tuple[int, int]]:
    """Ways to slice the sets of a class, one after another: slices, and the elements that a slice needs to be named."""
    most = most_differences(2 * largest, threshold)
    few = -(-largest // (2 * (most * 3 // 2 + 1)))
    return [(most * 3 // 2 + 1, few), (2 * most + 1, max(1, few - 1)), (3 * most + 1, 1)]


def slice_names(s: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Names of the slices of a sorted set, in each class it can meet a partner in.

    A partner leaves all but `most` slices as they are, however many there are. A split with more than `most` named
    slices will do, then; a set for which none does names the start of its order, which a partner's must meet."""
    out = []
    for c in classes_of(len(s), threshold):
        largest = int(CLASS_RATIO ** (c + 1))
        most = most_differences(len(s) + min(largest, int(len(s) / threshold)), threshold)
        for k, (m, few) in enumerate(splits(largest, threshold)):
            h = np.sort(mix(s + _U(k))) if k else s
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
            bounds = np.searchsorted(h, (np.arange(1, m, dtype=object) * (1 << 64) // m).astype(_U)) if m > 1 else np.zeros(0, np.int64)
            at = np.concatenate([[0], bounds, [len(h)]])
            held = np.flatnonzero(at[1:] - at[:-1] >= few)
            out.append(mix((sums[at[1:]] - sums[at[:-1]])[held] + mix(held.astype(_U) + _U((c << 32) + (k << 28)))))
            if len(held) > most:
                break
        else:
            start = s[: len(s) - ceil(threshold * len(s)) + 1]
            out.append(mix(start + mix(np.array([(c << 32) + (15 << 28)], _U))))
    return np.concatenate(out).view(np.int64)


def node_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0])


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether intersections of sets of sizes a and b make the threshold, in whole numbers."""
    return t.denominator * inter >= t.numerator * (a + b - inter)


class Region:
    """Sets that are joined within a task. Links are kept as a forest (union by least root)."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.t, self.eps = threshold, float(1 - threshold) + 1e-12
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        universe, self.code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.mark = np.zeros(len(universe), bool)
        sums = np.add.reduceat(np.stack([held[self.code], held[self.code] > 1], 1), self.ends[:-1])
        #: How common the elements of each set are; how many of them are in another set at all.
        self.weight, self.known = sums[:, 0] / self.size, sums[:, 1]
        self.root = np.arange(len(sets))

    def label(self, ids: np.ndarray) -> np.ndarray:
        r = self.root[ids]
        while (r != (up := self.root[r])).any():
            r = up
        self.root[ids] = r
        return r

    def union(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(self.label(np.append(others, i)))
        self.root[roots] = roots[0]

    def shared(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Elements that each of ids has in common with p."""
        own = self.code[self.ends[p] : self.ends[p + 1]]
        self.mark[own] = True
        sizes = self.size[ids]
        at = np.repeat(self.ends[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        got = np.add.reduceat(self.mark[self.code[at]].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[own] = False
        return got

    def distances(self, p: int, ids: np.ndarray) -> np.ndarray:
        s = self.shared(p, ids)
        self.take(p, ids, s)
        return 1 - s / (self.size[ids] + self.size[p] - s)

    def take(self, p: int, ids: np.ndarray, s: np.ndarray) -> None:
        near = ids[linked(s, self.size[ids], self.size[p], self.t)]
        if len(near):
            self.union(p, near)

    def pairs(self, ids: np.ndarray) -> None:
        """All links within ids: each in turn against those after it that windows and sizes allow. The first is the one
        whose elements are most common, as links known early spare most."""
        if len(ids) < 2:
            return
        d = self.distances(int(ids[self.weight[ids].argmax()]), ids)
        by = np.argsort(d, kind="stable")
        ids, d = ids[by], d[by]
        ends = np.searchsorted(d, d + self.eps, "right")
        for k in range(len(ids) - 1):
            later = ids[k + 1 : ends[k]]
            if not len(later):
                continue
            both = np.minimum(self.known[ids[k]], self.known[later])
            fits = both * (self.t.numerator + self.t.denominator) >= self.t.numerator * (self.size[ids[k]] + self.size[later])
            later = later[fits & (self.label(later) != self.label(ids[k : k + 1])[0])]
            if len(later):
                self.take(int(ids[k]), later, self.shared(int(ids[k]), later))

    def join(self, ids: np.ndarray) -> None:
        """Voronoi regions with boundary windows, recursively."""
        todo = [ids]
        while todo:
            ids = todo.pop()
            if len(ids) <= LEAF or len(np.unique(self.label(ids))) == 1:
                self.pairs(ids)
                continue
            # far apart pivots: each next one is the node farthest from those before it
            pivots, d = [int(ids[0])], [self.distances(int(ids[0]), ids)]
            while len(pivots) < min(8, 2 + len(ids) // LEAF):
                pivots.append(int(ids[np.min(d, axis=0).argmax()]))
                d.append(self.distances(pivots[-1], ids))
            d = np.array(d)
            inside = d <= d.min(0) + 2 * self.eps
            many = inside.sum(1)
            # regions overlap: where all have as many pairs as the whole, these would be met once in each, level by level
            if many.max() > 0.7 * len(ids) or (many**2).sum() > 0.7 * len(ids) ** 2:
                self.pairs(ids)
            else:
                todo += [ids[own] for own in inside if own.any()]


def _sets(df: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """doc_id, print (a hash of the text), n_shingles, node and names of the slices, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, names = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), n)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                names.append(slice_names(s, threshold) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(names, pa.list_(pa.int64()))], ["doc_id", "print", "n_shingles", "node", "names"])

    return _texts(df).mapInArrow(run, "doc_id long, print long, n_shingles long, node long, names array<long>")


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("print"), text_of().alias("text"))


def names_of_pass(i: int) -> Column:
    """The names of one pass."""
    # of one parameter: a second one would be bound to the index in the array, default or not
    return F.filter("names", lambda x: F.pmod(x, F.lit(PASSES)) == F.lit(i))


def _tied(names: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): every node that shares a name (the columns `by`) with another and the least node of that name."""
    # copies of a set name its slices again: dealing the names out twice to spare them would move more than they are
    shared = names.groupBy(*by).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select(*by, "pivot")
    shared = materialise(shared, "shared")  # a join of tables alone is split where one name has most of the rows
    return names.join(shared, by).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _ties(whole: DataFrame) -> DataFrame:
    """(a, b) of the names of slices."""
    parts = [materialise(_tied(whole.where("node is not null").select("node", F.explode(names_of_pass(i)).alias("name")), ["name"]), "ties") for i in range(PASSES)]
    return reduce(DataFrame.unionByName, parts)


def _elements(members: DataFrame) -> DataFrame:
    """grp, node, size (of its set) and element, of every element of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            sizes = np.array([len(s) for _, _, s in rows], np.int64)
            own = [np.repeat(np.array(x, np.int64), sizes) for x in ([r[0] for r in rows], [r[1] for r in rows], sizes)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.concatenate([s for _, _, s in rows]))], ["grp", "node", "size", "element"])

        rows, held = [], 0
        for b in batches:
            for grp, node, s in zip(*b.columns, strict=True):
                rows.append((grp.as_py(), node.as_py(), np.frombuffer(s.as_py(), np.int64)))
                held += len(rows[-1][2])
                if held > 100_000:
                    yield close(rows)
                    rows, held = [], 0
        if rows:
            yield close(rows)

    return members.select("grp", "node", "s").mapInArrow(run, "grp long, node long, size long, element long")


def _tightened(members: DataFrame, threshold: Fraction) -> DataFrame:
    """grp, node and s of the members that can have a partner, in clusters that hold all of it. members: one row a node.

    A set's elements come in the order of how many sets of its group hold them. Those of one set only come first and tie
    nothing, so a set that has `many` others and needs k in common ties by the rarest many - k + 1 of these. Linked sets
    have threshold / (1 + threshold) of their sizes in common, and meet in the size class of the smaller one."""
    total = members.agg(F.sum(F.length("s") / 8)).first()[0] or 0
    passes = max(1, ceil(total / ELEMENTS))
    parts = []
    for i in range(passes):
        own = _elements(members)
        own = own.where(F.pmod("element", F.lit(passes)) == i) if passes > 1 else own
        often = materialise(own.groupBy("grp", "element").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
        parts.append(materialise(own.join(often.hint("merge"), ["grp", "element"]), "common"))
    common = reduce(DataFrame.unionByName, parts).groupBy("grp", "node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("e"))
    num, den = threshold.numerator, threshold.denominator
    ratio = float(np.log(FINE_RATIO))
    least = F.expr(f"({num} * size + {den - 1}) div {den}")  # the smallest partner's size
    smaller = F.greatest(least, F.floor(F.pow(F.lit(FINE_RATIO), F.col("class"))))
    need = (F.lit(num) * (F.col("size") + smaller) + (num + den - 1)).cast("long")
    few = (F.size("e") + 1 - F.expr("need div %d" % (num + den))).cast("int")
    names = common.withColumn("class", F.explode(F.sequence(F.floor(F.log(least) / ratio), F.floor(F.log(F.col("size")) / ratio)))).withColumn("need", need).withColumn("few", few)
    names = names.where("few > 0").select("grp", "class", "node", F.explode(F.slice("e", 1, F.col("few"))).alias("e")).select("grp", "class", "node", "e.element")
    clusters = components(materialise(_tied(materialise(names, "rarest"), ["grp", "class", "element"]), "ties"))
    return members.select("node", "s").join(clusters.select(F.col("label").alias("grp"), "node").hint("merge"), "node").select("grp", "node", "s")


def _from_bytes(node: int, s: bytes) -> np.ndarray | None:
    return np.frombuffer(s, _U)


def _from_text(n: int) -> Callable[[int, str], np.ndarray | None]:
    """Reads the set of a text, None where it isn't the node's: a doc_id may be on rows of other texts too."""

    def read(node: int, text: str) -> np.ndarray | None:
        s = shingle_set(text, n)
        return s if len(s) and node_of(s) == node else None

    return read


def _join_in_tasks(members: DataFrame, threshold: Fraction, held: str = "s", read: Callable[[int, bytes | str], np.ndarray | None] = _from_bytes) -> DataFrame:
    """(a, b): a forest of the links within each group. members: grp, node, and in column `held` what read() makes a set of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(group: list[tuple]) -> pd.DataFrame:
            nodes = np.array([g[0] for g in group], np.int64)
            r = Region([g[1] for g in group], threshold)
            r.join(np.arange(len(nodes)))
            root = r.label(np.arange(len(nodes)))
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            return pd.DataFrame({"a": nodes[tied], "b": nodes[root[tied]]})

        own, group = None, []
        for f in frames:
            for key, node, value in zip(f["grp"], f["node"], f[held], strict=True):
                if key != own and group:
                    yield close(group)
                    group = []
                own = key
                # a node may come twice where a doc_id does
                if (not group or group[-1][0] != node) and (s := read(node, value)) is not None:
                    group.append((node, s))
        if group:
            yield close(group)

    return members.select("grp", "node", held).repartition("grp").sortWithinPartitions("grp", "node").mapInPandas(run, "a long, b long")


def _join_over_tasks(members: DataFrame, threshold: Fraction, depth: int = 3) -> DataFrame:
    """The same for groups of more than IN_TASK nodes: Voronoi regions level by level, pairs of blocks at the end."""
    eps = float(1 - threshold) + 1e-12
    found = None
    for _ in range(depth):
        members = materialise(members, "region")
        sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("many"))
        # 16 pivots a group: the least in hash order of 64 slots
        picks = members.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(16))).groupBy("grp", "slot").agg(F.min("node").alias("node"))
        pivots = picks.join(members.select("grp", "node", "s"), ["grp", "node"]).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("node", "s"))).alias("pivots"))
        pivots = materialise(pivots, "pivots")  # so that the join with a group of most rows is split

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for grp, node, s, pivots in zip(f["grp"], f["node"], f["s"], f["pivots"], strict=True):
                    own, d = np.frombuffer(s, _U), []
                    for p in pivots:
                        other = np.frombuffer(p["s"], _U)
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        d.append(1 - both / (len(own) + len(other) - both))
                    reach = min(d) + 2 * eps
                    rows += [(grp, int(p["node"]), node) for p, x in zip(pivots, d, strict=True) if x <= reach]
                yield pd.DataFrame(rows, columns=["old", "pivot", "node"])

        # regions are nodes only: where sets are far apart a node is in all of them, and its set would be there as often
        regions = members.join(pivots, "grp").select("grp", "node", "s", "pivots").mapInPandas(near, "old long, pivot long, node long")
        regions = materialise(regions.withColumn("grp", F.xxhash64("old", "pivot")), "regions")
        after = regions.groupBy("grp", "old").agg(F.count(F.lit(1)).alias("now")).join(sizes.withColumnRenamed("grp", "old"), "old")
        # a group with a region that doesn't shrink, or with large ones that share most of its nodes, is joined itself, once,
        # and none of its regions
        whole_of = after.groupBy("old", "many").agg(F.max("now").alias("most"), F.sum("now").alias("all"))
        stuck = whole_of.where((F.col("most") > IN_TASK) & ((F.col("most") > 0.7 * F.col("many")) | (F.col("all") > SETS_TWICE * F.col("many")))).select("old", F.col("many").alias("now"))
        after = materialise(after.join(stuck, "old", "left_anti"), "after")
        small = after.where(F.col("now") <= IN_TASK).select("grp")
        large = after.where(F.col("now") > IN_TASK).select("grp")
        whole = members.join(stuck.withColumnRenamed("old", "grp"), "grp")
        parts = [_join_dealt(regions.join(small, "grp", "left_semi").select("old", "grp", "node"), members, threshold), _join_blocks(whole, threshold)]
        for p in parts:
            found = p if found is None else found.unionByName(p)
        members = _with_sets(regions.join(large, "grp", "left_semi").select("old", "grp", "node"), members)
        if members.isEmpty():
            return found
    rest = members.join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("now")), "grp")
    return found.unionByName(_join_blocks(rest, threshold))


def _join_blocks(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of blocks of at most IN_TASK / 2 nodes, each pair in a task."""
    blocks = F.ceil(F.col("now") / (IN_TASK // 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.select("grp", "node", "now").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select(F.col("grp").alias("old"), F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "node")
    return _join_dealt(pairs, members, threshold)


def _with_sets(dealt: DataFrame, members: DataFrame) -> DataFrame:
    """grp, node and s of rows of old (the group that a node was in), grp and node."""
    sets = members.select(F.col("grp").alias("old"), "node", "s")
    return dealt.join(sets.hint("merge"), ["old", "node"]).select("grp", "node", "s")


def _join_dealt(dealt: DataFrame, members: DataFrame, threshold: Fraction) -> DataFrame:
    """_join_in_tasks() of nodes that are in several groups, in so many passes, each over its share of the groups, that
    no more than SETS_TWICE times the sets of members are on disk at once."""
    n, of = dealt.count(), members.count()
    passes = max(1, ceil(n / max(1, SETS_TWICE * of)))
    one = lambda i: dealt.where(F.pmod("grp", F.lit(passes)) == i) if passes > 1 else dealt
    return reduce(DataFrame.unionByName, [materialise(_join_in_tasks(_with_sets(one(i), members), threshold), "links") for i in range(passes)])


def ngram_components(df: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    whole, place = written(_sets(df, n, threshold), "shingles")
    rows = materialise(whole.drop("names"), "sets")
    clusters = components(_ties(whole))
    drop_written(df.sparkSession, place)  # the names have served
    # one row stands for all that share a node: copies are summed up in each map task, and not moved. Ids come first
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.min(first).alias("first")).select("node", "first.doc_id", "first.print"), "nodes")
    rep = materialise(nodes.join(clusters, "node"), "members")

    read = _from_text(n)

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(grp, node, read(node, text)) for grp, node, text in zip(f["grp"], f["node"], f["text"], strict=True)]
            yield pd.DataFrame([(grp, node, s.tobytes()) for grp, node, s in got if s is not None], columns=["grp", "node", "s"])

    texts = _texts(df).alias("t")
    # texts travel, not their sets: hashes are longer than words and don't compress
    same = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.print") == F.col("r.print"))
    # a merge join at every size: a small table of members would be sent to all tasks, and one that grew would not
    members = texts.join(rep.alias("r").hint("merge"), same).select(F.col("label").alias("grp"), "node", "text")
    sizes = lambda rows, by: rows.groupBy(F.col(by).alias("grp")).agg(F.count(F.lit(1)).alias("many"))
    loose = materialise(sizes(clusters, "label").where(F.col("many") > min(LOOSE, IN_TASK)).select("grp"), "loose")
    if loose.isEmpty():
        links = _join_in_tasks(members, threshold, "text", read)
    else:
        links = _join_in_tasks(members.join(loose, "grp", "left_anti"), threshold, "text", read)
        big = members.join(loose, "grp", "left_semi").mapInPandas(sets, "grp long, node long, s binary")
        big = materialise(_tightened(materialise(big.dropDuplicates(["node"]), "members"), threshold), "tight")
        large = materialise(sizes(big, "grp").where(F.col("many") > IN_TASK).select("grp"), "large")
        links = links.unionByName(_join_in_tasks(big.join(large, "grp", "left_anti"), threshold))
        if not large.isEmpty():
            links = links.unionByName(_join_over_tasks(big.join(large, "grp", "left_semi"), threshold))
    found = components(links)
    own = materialise(nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("doc_id").alias("least")), "nodes")
    ids = materialise(own.groupBy("label").agg(F.min("least").alias("component_id")), "ids")
    of = materialise(own.join(ids, "label").select("node", "component_id"), "of")
    return rows.join(of, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
