"""Operator 11: hard negatives by a search over two trees.

Vectors become whole numbers, floor(scale * x); a score is an inner product of two of them, in whole numbers. An
anchor's positives are its best rows of the same label; for each positive come the best rows of other labels whose score
is from low to high hundredths of the positive's. Higher scores come first, ties by smaller id.

Method: one tree over the anchors and one over all rows, both of balls: a node's centre is fixed, its radius is the
largest distance of any row below it. Centres c, d and radii r, s bound every inner product of two nodes by
<c, d> +- (|c| s + |d| r + r s). A descent of both trees at once drops pairs of nodes whose interval holds no score that
some anchor below still wants, with all anchors and rows below them. Rows of leaves are packed into blocks of at most
about PER_BLOCK, anchors into groups of GROUP; a group meets the blocks of the leaves that were left to it, one matrix
product a pair. What an anchor wants is known beforehand: `sample` rows that every task holds give it a score that its
k-th best result cannot fall below. First the positives are searched so, then the negatives in their windows.

Trees are cut by the main direction of at most `fit_rows` rows (the least by hash) into at most LEAVES leaves; that
bounds what the driver holds and sees of the tables. All rows are in the trees, the search is exact: centres and cuts say
what can be dropped, never what counts. A task keeps the best that each group has met in its blocks: a block has to reach
what those before it had, and few rows leave the task. Rows of one leaf are dealt over blocks by their ids, so a vector
that a third of the rows share is no hot group. Products are taken in single or double precision where that is exact
(norms whose product is below 2**24 or 2**53) and as Python integers beyond; scores that no long holds end at its limits.

Rows whose id, label or vector is null, or that hold a null or non-finite component or none at all, take no part, nor do
vectors of another length than most. Rows that agree in id, label and vector count once; rows that share an id only are
rows of their own. Anchors without a positive, and positives without a negative, give no rows. Labels may be strings or
numbers of any kind. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FIT_ROWS = 20_000
LEAVES = 512
PER_BLOCK = 4_096
GROUP = 256
#: How much wider than computed an interval is taken, relative to its terms.
SLACK = 1e-9
EXACT = float(1 << 53)
#: The same for single precision.
SINGLE = float(1 << 24)
#: The groups of which a task keeps the best at a time.
GROUPS_HELD = 64
#: The largest long.
LONGEST = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PACKED = "part long, leaf int, ids binary, labels binary, vectors binary"


def taking_part(df: DataFrame, anchors: Column, scale: int, id_column: str, label_column: str, column: str) -> DataFrame:
    """id, label (a number for each distinct label), q (array of long) and anchor of the rows that take part."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    rows = df.withColumn("_anchor", F.coalesce(anchors, F.lit(False))).where(some).where(~odd)
    label = F.col(label_column)
    number = label.cast("long") if df.schema[label_column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col(id_column).cast("long").alias("id"), number.alias("label"), q.alias("q"), F.col("_anchor").alias("anchor"))


@dataclass
class Tree:
    """A tree of cuts: node k has the children 2k + 1 and 2k + 2, the nodes of the last level are the leaves."""

    depth: int
    directions: np.ndarray
    at: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    #: Rows of each leaf, the number of its parts and the first of them.
    sizes: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    @property
    def before_leaves(self) -> int:
        return 2**self.depth - 1

    @classmethod
    def fitted(cls, x: np.ndarray, depth: int) -> Tree:
        """Cut along the main direction of the rows below each node, at the widest gap of their middle half; no row is in it yet."""
        nodes, leaves = 2 ** (depth + 1) - 1, 2**depth
        none = np.zeros(leaves, np.int64)
        tree = cls(depth, np.zeros((nodes, x.shape[1])), np.zeros(nodes), np.zeros((nodes, x.shape[1])), np.full(nodes, -1.0), none, none, none)
        below = [np.arange(len(x))] + [none[:0]] * (nodes - 1)
        for k in range(nodes):
            rows = x[below[k]]
            tree.centres[k] = rows.mean(0) if len(rows) else tree.centres[(k - 1) // 2]
            if k >= leaves - 1:
                continue
            if len(rows):
                away = rows - tree.centres[k]
                way = away[np.einsum("ij,ij->i", away, away).argmax()]
                for _ in range(4):
                    way = way / max(np.linalg.norm(way), 1e-300)
                    way = away.T @ (away @ way)
                tree.directions[k] = way / max(np.linalg.norm(way), 1e-300)
                own = np.sort(rows @ tree.directions[k])[len(rows) // 4 : -(-3 * len(rows) // 4) + 1]
                gap = np.diff(own).argmax() if len(own) > 1 else 0
                tree.at[k] = own[gap : gap + 2].mean()
            right = rows @ tree.directions[k] > tree.at[k]
            below[2 * k + 1], below[2 * k + 2] = below[k][~right], below[k][right]
        return tree

    def paths(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each row the node it is in, level by level down to its leaf."""
        node = np.zeros(len(x), np.int64)
        yield node
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.directions[node]) > self.at[node])
            yield node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        for node in self.paths(x):
            pass
        return node - self.before_leaves

    def part_of(self, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[leaf] + (pd.util.hash_array(ids) % self.parts[leaf].astype(np.uint64)).astype(np.int64)

    def upwards(self, of_leaf: np.ndarray, least: bool) -> np.ndarray:
        """A value for every node from those of its leaves."""
        out = np.concatenate([np.zeros(self.before_leaves), of_leaf])
        for k in range(self.before_leaves - 1, -1, -1):
            out[k] = (min if least else max)(out[2 * k + 1], out[2 * k + 2])
        return out


def interval(dot: np.ndarray, c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of two balls, from that of their centres, the centres' norms and the radii."""
    span = c * s + d * r + r * s
    span = span + SLACK * (c * d + span)
    return dot - span, dot + span


def left_pairs(a: Tree, b: Tree, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Of each leaf of a the leaves of b that may hold a score in its wanted range, by a descent of both trees."""
    dots = a.centres @ b.centres.T
    c, d = np.linalg.norm(a.centres, axis=1), np.linalg.norm(b.centres, axis=1)
    low, high = a.upwards(low, True), a.upwards(high, False)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(a.depth, b.depth) + 1):
        if level:
            i = (2 * i[:, None] + [1, 2] if level <= a.depth else np.stack([i, i], 1))[:, :, None]
            j = (2 * j[:, None] + [1, 2] if level <= b.depth else np.stack([j, j], 1))[:, None, :]
            i, j = (x.reshape(-1) for x in np.broadcast_arrays(i[:, : 2 if level <= a.depth else 1], j[:, :, : 2 if level <= b.depth else 1]))
        from_, to = interval(dots[i, j], c[i], a.radii[i], d[j], b.radii[j])
        keep = (a.radii[i] >= 0) & (b.radii[j] >= 0) & (to >= low[i]) & (from_ <= high[i])
        i, j = i[keep], j[keep]
    leaf, other = i - a.before_leaves, j - b.before_leaves
    return [other[leaf == k] for k in range(2**a.depth)]


def built(rows: DataFrame, sample: np.ndarray, number: int, most: int) -> Tree:
    """The tree of all rows, cut by the sample; each leaf in parts of about `most` rows."""
    leaves = min(LEAVES, -(-number // most))
    tree = Tree.fitted(sample, max(0, (leaves - 1).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # at most 2 * LEAVES nodes

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        radii, sizes = np.full(len(tree.at), -1.0), np.zeros(len(tree.at), np.int64)
        for f in frames:
            if len(f):
                x = np.stack(f["q"].to_numpy()).astype(float)
                for node in tree.paths(x):
                    away = x - tree.centres[node]
                    np.maximum.at(radii, node, np.sqrt(np.einsum("ij,ij->i", away, away)))
                    sizes += np.bincount(node, minlength=len(sizes))
        seen = np.flatnonzero(sizes)
        yield pd.DataFrame({"node": seen, "radius": radii[seen], "n": sizes[seen]})

    every = rows.select("q").mapInPandas(reach, "node long, radius double, n long").groupBy("node").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).toPandas()
    tree.radii[every["node"].to_numpy()] = every["radius"].to_numpy()
    sizes = np.zeros(len(tree.at), np.int64)
    sizes[every["node"].to_numpy()] = every["n"].to_numpy()
    tree.sizes = sizes[tree.before_leaves :]
    tree.parts = np.maximum(1, -(-tree.sizes // most))
    tree.first = np.cumsum(tree.parts) - tree.parts
    return tree


def packed(rows: DataFrame, tree: Tree) -> DataFrame:
    """One row a part of a leaf: ids, labels and vectors of its distinct rows, by id."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                leaf = shared.value.leaf_of(np.stack(f["q"].to_numpy()).astype(float))
                yield f.assign(leaf=leaf.astype(np.int32), part=shared.value.part_of(leaf, f["id"].to_numpy()))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(bytes=[np.ascontiguousarray(q, "<i8").tobytes() for q in f["q"]])
        f = f.drop_duplicates(["id", "label", "bytes"]).sort_values(["id", "label", "bytes"])
        as_bytes = lambda name: f[name].to_numpy().astype("<i8").tobytes()
        return pd.DataFrame([(f["part"].iloc[0], f["leaf"].iloc[0], as_bytes("id"), as_bytes("label"), b"".join(f["bytes"]))], columns=["part", "leaf", "ids", "labels", "vectors"])

    dealt = rows.select("id", "label", "q").mapInPandas(placed, "id long, label long, q array<long>, leaf int, part long")
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    cast: np.ndarray | None = None

    @classmethod
    def of(cls, ids: bytes, labels: bytes, vectors: bytes) -> Block:
        ids = np.frombuffer(ids, "<i8")
        return cls(ids, np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i8").reshape(len(ids), -1))

    def scores(self, other: Block, kind: type) -> np.ndarray:
        """Inner products, in whole numbers: kind is a float type that holds them and all their partial sums, or object."""
        if kind is not object:
            return self.held(kind) @ other.held(kind).T
        return np.clip(self.q.astype(object) @ other.q.T.astype(object), -LONGEST - 1, LONGEST).astype(np.int64)

    def held(self, kind: type) -> np.ndarray:
        """The vectors as that type, made once."""
        if self.cast is None or self.cast.dtype != kind:
            self.cast = self.q.astype(kind)
        return self.cast

    def wanted(self, slot: int, other: Block, same: bool) -> np.ndarray:
        """Which rows of other may stand beside the row at slot: those of its label but itself, or of other labels."""
        if not same:
            return other.labels != self.labels[slot]
        out = other.labels == self.labels[slot]
        for p in np.flatnonzero(out & (other.ids == self.ids[slot])):
            out[p] = not np.array_equal(other.q[p], self.q[slot])
        return out


@dataclass(frozen=True)
class Search:
    """The k best rows for each want: slot (of the anchor in its group), turn, low and high (the scores wanted)."""

    tree: Tree
    anchors: Tree
    sample: Block
    kind: type
    k: int
    same: bool

    def floors(self, group: Block, wants: np.ndarray) -> np.ndarray:
        """wants, low raised to what k rows of the sample reach."""
        scores, out = group.scores(self.sample, self.kind), wants.copy()
        for slot in np.unique(wants[:, 0]):
            of = scores[slot][group.wanted(slot, self.sample, self.same)]
            for n in np.flatnonzero(wants[:, 0] == slot):
                held = of[(of >= wants[n, 2]) & (of <= wants[n, 3])]
                if len(held) >= self.k:
                    out[n, 2] = max(out[n, 2], int(np.sort(held)[-self.k]))
        return out

    def blocks_of(self, group: Block, wants: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Parts of the leaves whose balls may hold what this group wants."""
        q, tree = group.q.astype(float), self.tree
        centre = q.mean(0)
        away = q - centre
        nodes = leaves + tree.before_leaves
        r = np.sqrt(np.einsum("ij,ij->i", away, away).max())
        d = tree.centres[nodes]
        from_, to = interval(d @ centre, np.linalg.norm(centre), r, np.linalg.norm(d, axis=1), tree.radii[nodes])
        keep = leaves[(to >= wants[:, 2].min()) & (from_ <= wants[:, 3].max())]
        return np.concatenate([tree.first[x] + np.arange(tree.parts[x]) for x in keep]) if len(keep) else np.empty(0, np.int64)


class Best:
    """The k best rows that one group has met so far; each block that it meets raises what the next one has to reach."""

    def __init__(self, search: Search, group: Block, wants: np.ndarray):
        self.search, self.group = search, group
        self.wants = wants[np.argsort(wants[:, 0], kind="stable")].copy()
        self.low, self.high = self.wants[:, 2].copy(), self.wants[:, 3]
        self.slots, self.first, self.many = np.unique(self.wants[:, 0], return_index=True, return_counts=True)
        none = np.zeros(0, np.int64)
        self.want, self.ids, self.scores = none, none, none

    def among(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of slots) and columns of the scores that some want of the slot may take."""
        low, high = np.minimum.reduceat(self.low, self.first), np.maximum.reduceat(self.high, self.first)
        if scores.dtype != np.int64:
            # no score reaches the ends of what its type tells apart
            end = int(SINGLE if scores.dtype == np.float32 else EXACT)
            low, high = (np.clip(x, -end, end).astype(scores.dtype) for x in (low, high))
        return np.divmod(np.flatnonzero((scores >= low[:, None]) & (scores <= high[:, None])), scores.shape[1])

    def meet(self, block: Block) -> None:
        group, k = self.group, self.search.k
        scores = group.scores(block, self.search.kind)[self.slots]
        at, col = self.among(scores)
        of, slot = scores[at, col].astype(np.int64), self.slots[at]
        keep = (block.labels[col] == group.labels[slot]) == self.search.same
        if self.search.same:
            for p in np.flatnonzero(keep & (block.ids[col] == group.ids[slot])):
                keep[p] = not np.array_equal(block.q[col[p]], group.q[slot[p]])
        at, col, of = at[keep], col[keep], of[keep]
        parts = [(self.want, self.ids, self.scores)]
        for turn in range(int(self.many.max())):
            want = self.first[at] + turn
            fit = turn < self.many[at]
            fit[fit] = (of[fit] >= self.low[want[fit]]) & (of[fit] <= self.high[want[fit]])
            parts.append((want[fit], block.ids[col[fit]], of[fit]))
        want, ids, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ~of, want))  # ~x falls as x grows, for every long
        want, ids, of = want[order], ids[order], of[order]
        rank = np.arange(len(want)) - np.searchsorted(want, want)
        last = rank == k - 1
        self.low[want[last]] = np.maximum(self.low[want[last]], of[last])
        self.want, self.ids, self.scores = want[rank < k], ids[rank < k], of[rank < k]

    def rows(self, part: int) -> pd.DataFrame:
        of = self.wants[self.want]
        return pd.DataFrame({"part": np.full(len(of), part, np.int64), "slot": of[:, 0], "turn": of[:, 1], "id": self.ids, "score": self.scores})


def as_long(x: float | int) -> int:
    return max(-LONGEST - 1, min(LONGEST, int(x)))


def searched(groups: DataFrame, blocks: DataFrame, search: Search) -> DataFrame:
    """part (of the group), slot, turn, rank, id, score. groups: PACKED and wants, rows of four longs."""
    sc = groups.sparkSession.sparkContext
    shared = sc.broadcast(search)  # two trees of at most 2 * LEAVES nodes and a sample of bounded size

    def raised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for ids, labels, vectors, wants in zip(f["ids"], f["labels"], f["vectors"], f["wants"], strict=True):
                out = shared.value.floors(Block.of(ids, labels, vectors), np.frombuffer(wants, "<i8").reshape(-1, 4))
                rows.append((out.tobytes(), int(out[:, 2].min()), int(out[:, 3].max())))
            yield pd.DataFrame(rows, columns=["wants", "low", "high"], index=f.index).join(f.drop(columns="wants"))[["part", "leaf", "ids", "labels", "vectors", "wants", "low", "high"]]

    # groups are few and long rows of one file: dealt over all cores, as each is compared with the whole sample
    dealt = groups.where(F.length("wants") > 0).repartition(4 * max(sc.defaultParallelism, 1), "part")
    known = materialise(dealt.mapInPandas(raised, f"{PACKED}, wants binary, low long, high long"), "groups")
    wanted = known.groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # at most LEAVES rows
    leaves = 2**search.anchors.depth
    low, high = np.full(leaves, np.inf), np.full(leaves, -np.inf)
    low[wanted["leaf"]], high[wanted["leaf"]] = wanted["low"], wanted["high"]
    left = sc.broadcast(left_pairs(search.anchors, search.tree, low, high))  # at most LEAVES ** 2 numbers

    def towards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            meets = [shared.value.blocks_of(Block.of(i, x, v), np.frombuffer(w, "<i8").reshape(-1, 4), left.value[leaf]) for leaf, i, x, v, w in zip(f["leaf"], f["ids"], f["labels"], f["vectors"], f["wants"], strict=True)]
            yield f.assign(meets=meets)[["part", "ids", "labels", "vectors", "wants", "meets"]]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, Best] = {}
        meet, block = None, None
        for f in frames:
            for r in f.itertuples(index=False):
                if r.meet != meet:  # the join brings the groups of one block one after another
                    meet, block = r.meet, Block.of(r.b_ids, r.b_labels, r.b_vectors)
                if r.part not in best:
                    if len(best) == GROUPS_HELD:
                        yield pd.concat([b.rows(part) for part, b in best.items()])
                        best.clear()
                    best[r.part] = Best(shared.value, Block.of(r.ids, r.labels, r.vectors), np.frombuffer(r.wants, "<i8").reshape(-1, 4))
                best[r.part].meet(block)
        if best:
            yield pd.concat([b.rows(part) for part, b in best.items()])

    sent = known.drop("low", "high").mapInPandas(towards, "part long, ids binary, labels binary, vectors binary, wants binary, meets array<long>")
    there = blocks.select(F.col("part").alias("meet"), *(F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vectors")))
    pairs = sent.withColumn("meet", F.explode("meets")).drop("meets").join(there.hint("merge"), "meet")  # a group goes to most blocks: no table to send whole
    found = pairs.mapInPandas(scored, "part long, slot long, turn long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("part", "slot", "turn").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= search.k)


def mine(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_column: str = "vec_id",
    label_column: str = "label",
    column: str = "embedding",
    fit_rows: int = FIT_ROWS,
    per_block: int = PER_BLOCK,
    group: int = GROUP,
    sample: int = 4_096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of df that `anchors` holds
    for. low, high: whole hundredths of a positive's score."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], RESULT)
    rows = taking_part(df, anchors, scale, id_column, label_column, column)
    widths = rows.groupBy(F.size("q").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return empty
    rows = materialise(rows.where(F.size("q") == widths[0]["w"]), "whole")
    asked = rows.where("anchor")
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("asked"), F.max(square).alias("norm")).first()
    if not facts["asked"]:
        return empty

    def least(of: DataFrame, most: int) -> pd.DataFrame:
        return of.select("id", "label", "q").orderBy(F.xxhash64("id", "label", "q")).limit(most).toPandas()

    known, known_anchors = least(rows, fit_rows), least(asked, fit_rows)
    x, y = (np.stack(f["q"].to_numpy()).astype(float) for f in (known, known_anchors))
    tree, over = built(rows, x, facts["n"], per_block), built(asked, y, facts["asked"], group)
    blocks, groups = materialise(packed(rows, tree), "blocks"), materialise(packed(asked, over), "anchors")
    some = known.assign(bytes=[np.ascontiguousarray(q).tobytes() for q in known["q"]]).drop_duplicates(["id", "label", "bytes"]).head(sample)
    held = Block(some["id"].to_numpy(), some["label"].to_numpy(), np.stack(some["q"].to_numpy()))
    kind = np.float32 if facts["norm"] < SINGLE else np.float64 if facts["norm"] < EXACT else object

    def everything(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wants = [np.array([(s, 0, -LONGEST - 1, LONGEST) for s in range(len(i) // 8)], "<i8").tobytes() for i in f["ids"]]
            yield f.assign(wants=wants)

    wide = groups.mapInPandas(everything, f"{PACKED}, wants binary")
    found = searched(wide, blocks, Search(tree, over, held, kind, positives, True))
    best = materialise(found.select("part", "slot", F.col("rank").cast("long").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wants = []
            for best in f["best"]:
                each = ((r["slot"], r["turn"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in best)
                wants.append(np.array([(s, t, as_long(a), as_long(b)) for s, t, a, b in each if a <= b], "<i8").tobytes())
            yield f.assign(wants=wants).drop(columns="best")

    # GROUP anchors have at most so many positives each
    of_group = best.groupBy("part").agg(F.collect_list(F.struct("slot", "turn", F.col("positive_score").alias("score"))).alias("best"))
    narrow = groups.join(of_group, "part").select("part", "leaf", "ids", "labels", "vectors", "best").mapInPandas(windows, f"{PACKED}, wants binary")
    mined = searched(narrow, blocks, Search(tree, over, held, kind, negatives, False))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, ids in zip(f["part"], f["ids"], strict=True):
                ids = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"part": part, "slot": np.arange(len(ids)), "anchor_id": ids})

    names = groups.select("part", "ids").mapInPandas(named, "part long, slot long, anchor_id long")
    out = mined.select("part", "slot", "turn", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["part", "slot", "turn"]).join(names, ["part", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
