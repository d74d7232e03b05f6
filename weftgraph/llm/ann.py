"""Operator 3: approximate nearest neighbours with an inverted multi-index.

Method: a vector is cut into two halves, each quantised by its own codebook of K centroids; a cell is a pair of
centroids, so K * K cells need two small codebooks only. A query sums the distances (here: negated inner products)
of its halves to the centroids and takes the pairs in order of the sum with a heap, until the cells hold as many
entries as it may look at. These entries are reranked by the exact inner product in double precision. K is a sixth
of the entries and 256 at most: finer codebooks order entries better, and a query has to look at fewer.

The codebooks are fitted on at most `fit_rows` vectors (the least by hash, so any table gives the same); every
vector is indexed. Equal vectors are one entry with the k + 1 smallest of their ids, which suffices for k
neighbours other than the query itself, so a vector that a third of the table holds is no hot cell. Entries are
packed into blocks of bounded size, one row each, and so are the queries that look at a block; they meet in a join on
the block, so entries move once however many queries there are. A block returns the best k of each query and the best
of these are the result.

Vectors that are null, empty, of another length than most, zero, or hold null or non-finite components take no
part; rows of null id neither. Of rows that share an id and vector one counts. Equal scores go to the smaller id.
Where there are fewer than k candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FIT_ROWS = 20_000
MOST_CENTROIDS = 256
PER_BLOCK = 2_048
QUERIES_PER_BLOCK = 2_048
#: Distances are summed anew where entries are, and may differ in the last bits: by so much of the product of a
#: query's length and the largest of an entry or centroid.
SLACK = 1e-12
#: Copies of one vector that are ranked together before the best of them meet.
COPIES_TOGETHER = 20_000
FOUND = "query_id long, vec_id long, score double"


def taking_part(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_column).isNotNull() & v.isNotNull()).where(~odd & some).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's rounds from a spread start; an empty cluster takes the row that lies farthest off."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        near = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for empty in np.flatnonzero(n == 0):
            c[empty] = x[d.min(1).argmax()]
    return c


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    i, j = (((b * b).sum(1)[None, :] - 2 * part @ b.T).argmin(1) for part, b in ((x[:, :half], books[0]), (x[:, half:], books[1])))
    return i * len(books[1]) + j


class Cells:
    """The cells that hold entries, in rows of one first centroid each."""

    def __init__(self, cells: np.ndarray, sizes: np.ndarray, width: int):
        self.first, self.second = cells // width, cells % width
        self.rows, self.starts = np.unique(self.first, return_index=True)
        ends = [*self.starts[1:].tolist(), len(cells)]
        self.spans = [slice(a, b) for a, b in zip(self.starts.tolist(), ends, strict=True)]
        self.sizes = sizes

    def reach(self, a: np.ndarray, b: np.ndarray, enough: int) -> float:
        """The summed distance within which the cells hold `enough` entries (all, if there are fewer).

        a and b: a query's distances to the centroids. A heap holds the nearest cell of each row that was not taken
        yet, so centroid pairs come in order of their sum; a row is sorted when its first cell comes up. The heap
        starts behind a distance, judged by a sample of the cells, within which there surely is less than enough."""
        sums = a[self.first] + b[self.second]
        step = -(-len(sums) // 1024)
        order = sums[::step].argsort()
        held = np.cumsum(self.sizes[::step][order]) * step
        for part in (0.9, 0.6, 0.0):
            k = int(np.searchsorted(held, part * enough)) - 1
            far = float(sums[::step][order[k]]) if k >= 0 and part else -math.inf
            within = sums <= far
            if (got := int(self.sizes[within].sum())) < enough:
                break
        sums[within] = math.inf
        heap = list(zip(np.minimum.reduceat(sums, self.starts).tolist(), range(len(self.rows)), strict=True))
        heapq.heapify(heap)
        rest: dict[int, Iterator[tuple[float, int]]] = {}
        now: dict[int, int] = {}
        while heap and got < enough and heap[0][0] < math.inf:
            far, r = heap[0]
            if r not in rest:
                own = self.spans[r]
                order = sums[own].argsort(kind="stable")
                rest[r] = iter(zip(sums[own][order].tolist(), self.sizes[own][order].tolist(), strict=True))
                now[r] = next(rest[r])[1]
            got += now[r]
            if (after := next(rest[r], None)) is None:
                heapq.heappop(heap)
            else:
                now[r] = after[1]
                heapq.heapreplace(heap, (after[0], r))
        return far


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def entries_of(vectors: DataFrame, total: int, k: int) -> DataFrame:
    """v and ids: each distinct vector with the k + 1 smallest of its ids."""
    rows, salts = vectors.dropDuplicates(["id", "v"]), max(1, -(-total // COPIES_TOGETHER))
    while True:
        by = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
        rows = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1).drop("_r")
        if salts == 1:
            break
        salts = -(-salts // 500) if salts > 500 else 1
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(df: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.33, depth: int = 20, id_column: str = "vec_id", column: str = "embedding", fit_rows: int = FIT_ROWS, per_block: int = PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found in df for each row of queries (same columns as df).

    A query looks at the nearest cells that hold `share` of the entries, and no fewer than `depth` entries for each
    neighbour that it returns."""
    spark = df.sparkSession
    vectors = taking_part(df, id_column, column)
    widths = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width, total = widths[0]["w"], widths[0]["count"]
    entries = materialise(entries_of(vectors.where(F.size("v") == width), total, k), "vectors")
    sample = entries.select("v").orderBy(F.xxhash64("v")).limit(fit_rows).toPandas()
    x = np.stack(sample["v"].to_numpy())
    number = entries.count()
    size = min(MOST_CENTROIDS, max(2, -(-number // 6)))
    half = max(1, width // 2)
    if width == 1:
        books = (k_means(x, size), np.zeros((1, 0)))
    else:
        books = (k_means(x[:, :half], size), k_means(x[:, half:], size))
    shared = spark.sparkContext.broadcast(books)  # two codebooks of at most MOST_CENTROIDS centroids
    known = spark.sparkContext.broadcast((x, cells_of(x, books)))  # the sample that they were fitted on
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    # a centroid lies within the vectors that it was fitted on
    slack = SLACK * math.sqrt(entries.agg(F.max(square)).first()[0])

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(cell=cells_of(np.stack(f["v"].to_numpy()), shared.value))

    indexed = materialise(entries.mapInPandas(placed, "v array<double>, ids array<long>, cell int"), "index")
    counted = indexed.groupBy("cell").count().orderBy("cell").toPandas()  # at most MOST_CENTROIDS ** 2 rows
    cells, sizes = counted["cell"].to_numpy().astype(np.int64), counted["count"].to_numpy()
    # cells go to blocks of a bounded number of entries; a larger cell is dealt over several blocks
    parts = np.maximum(1, -(-sizes // per_block))
    per = np.concatenate([[0], np.cumsum(np.repeat(-(-sizes // parts), parts))])
    block = per[:-1] // per_block
    plan = spark.sparkContext.broadcast((cells, sizes, parts, np.cumsum(parts) - parts, block))
    asked = taking_part(queries, id_column, column).where(F.size("v") == width).dropDuplicates(["id", "v"])
    n_queries = asked.count()
    slices = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    enough, k_best = max(depth * k, math.ceil(share * number)), k + 1

    def distances(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(v[:, :half] @ shared.value[0].T), -(v[:, half:] @ shared.value[1].T)

    def to_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, _, parts, first, block = plan.value
        for f in frames:
            at = np.searchsorted(cells, f["cell"].to_numpy())
            key = pd.util.hash_array(np.array([i[0] for i in f["ids"]], np.int64))
            yield f.assign(block=block[first[at] + (key % parts[at].astype(np.uint64)).astype(np.int64)])

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        """A block's entries as one row; ids of one entry lie next to each other, held says how many they are."""
        ids = f["ids"].tolist()
        row = (f["block"].iloc[0], np.stack(f["v"].to_numpy()).tobytes(), f["cell"].to_numpy(np.int32).tobytes(), np.concatenate(ids).astype("<i8").tobytes(), np.array([len(i) for i in ids], np.int32).tobytes())
        return pd.DataFrame([row], columns=["block", "vectors", "cells", "ids", "held"])

    def pack_queries(f: pd.DataFrame) -> pd.DataFrame:
        q = np.concatenate([np.stack(f["v"].to_numpy()), f[["far", "floor"]].to_numpy()], axis=1)
        return pd.DataFrame([(f["block"].iloc[0], f["id"].to_numpy(np.int64).tobytes(), q.tobytes())], columns=["block", "askers", "asked"])

    def to_probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, sizes, parts, _, block = plan.value
        grid = Cells(cells, sizes, len(shared.value[1]))
        of_part = np.repeat(np.arange(len(cells)), parts)
        sample, home = known.value
        many = len(shared.value[1])
        for f in frames:
            for k in range(0, len(f), 256):
                asked = f.iloc[k : k + 256]
                q = np.stack(asked["v"].to_numpy())
                first, second = distances(q)
                scores = q @ sample.T
                rows: list[tuple] = []
                for n, (id_, v) in enumerate(zip(asked["id"], asked["v"], strict=True)):
                    wide = slack * float(np.linalg.norm(q[n]))
                    far = grid.reach(first[n], second[n], enough) + wide
                    near = first[n][grid.first] + second[n][grid.second] <= far
                    # of the sample's entries that the query looks at anyway k + 1 score this much or more
                    seen = scores[n][first[n][home // many] + second[n][home % many] <= far]
                    floor = float(np.partition(seen, len(seen) - k_best)[len(seen) - k_best]) - wide if len(seen) >= k_best else -math.inf
                    rows += [(b, int(id_ % slices), id_, v, far, floor) for b in np.unique(block[near[of_part]]).tolist()]
                yield pd.DataFrame(rows, columns=["block", "slice", "id", "v", "far", "floor"])

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = len(shared.value[1])
        for f in frames:
            for r in f.itertuples(index=False):
                out: list[tuple] = []
                x = np.frombuffer(r.vectors, float).reshape(-1, width)
                cell, own = np.unique(np.frombuffer(r.cells, np.int32), return_inverse=True)
                ids, held = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.held, np.int32)
                start = np.cumsum(held) - held
                least = ids[start]
                q = np.frombuffer(r.asked, float).reshape(-1, width + 2)
                first, second = distances(q[:, :width])
                for n, asker in enumerate(np.frombuffer(r.askers, "<i8").tolist()):
                    v, far, floor = q[n, :width], q[n, width], q[n, width + 1]
                    at = np.flatnonzero((first[n][cell // many] + second[n][cell % many] <= far)[own])
                    scores = x[at] @ v
                    at, scores = at[scores >= floor], scores[scores >= floor]
                    near = at[best(least[at], scores, k_best)]
                    found = [(asker, i, float(np.dot(x[p], v))) for p in near for i in ids[start[p] : start[p] + held[p]].tolist() if i != asker]
                    found.sort(key=lambda r: (-r[2], r[1]))
                    out += found[:k]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    laid = indexed.mapInPandas(to_blocks, "v array<double>, ids array<long>, cell int, block long")
    left = materialise(laid.groupBy("block").applyInPandas(pack, "block long, vectors binary, cells binary, ids binary, held binary"), "blocks")
    # a traversal takes longer than its row: queries are dealt over all cores, a few thousand to a task at most
    spread = max(spark.sparkContext.defaultParallelism, -(-n_queries // QUERIES_PER_BLOCK))
    right = asked.repartition(spread, "id").mapInPandas(to_probes, "block long, slice int, id long, v array<double>, far double, floor double")
    found = right.groupBy("block", "slice").applyInPandas(pack_queries, "block long, askers binary, asked binary").join(left, "block").mapInPandas(rerank, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
