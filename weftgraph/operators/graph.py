"""The typed, counted file-dependency graph and its relational analyses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

# Kinds of edges in their order.
KINDS = ("import", "link", "asset", "test", "type_only", "dynamic")


class GraphError(ValueError):
    """InvalidPath, UnknownPath, InvalidCount: what a graph can't be made of."""


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1


@dataclass(frozen=True)
class DependencyGraph:
    """paths (path) and edges (src, dst, kind, count): one row a pair and kind."""

    paths: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, paths: DataFrame, edges: DataFrame) -> DependencyGraph:
        """Coalesces edges: counts of a pair and kind are summed. Paths and ends must be normal already."""
        return cls(paths.distinct(), edges.groupBy("src", "dst", "kind").agg(F.sum("count").alias("count")))

    @classmethod
    def checked(cls, paths: DataFrame, edges: DataFrame) -> DependencyGraph:
        """The same from raw spellings: normalizes them, and raises GraphError for paths that are refused, ends that
        are no paths, and counts below one."""
        own = paths.select(F.col("path").alias("raw"), P.normalize("path").alias("path"))
        if bad := own.where("path is null").select("raw").head():
            raise GraphError(f"InvalidPath: {bad['raw']}")
        nodes = own.select("path").distinct()
        ends = edges.select(P.normalize("src").alias("src"), P.normalize("dst").alias("dst"), "kind", "count")
        if ends.where("count < 1").head():
            raise GraphError("InvalidCount")
        every = ends.select(F.explode(F.array("src", "dst")).alias("path"))
        if (stray := every.join(nodes, "path", "left_anti").head()) is not None:
            raise GraphError(f"UnknownPath: {stray['path']}")
        return cls.from_edges(nodes, ends)

    def pairs(self) -> DataFrame:
        """Distinct (src, dst), whatever the kind."""
        return self.edges.select("src", "dst").distinct()

    def contains(self, path: str) -> bool:
        return self.paths.where(F.col("path") == path).head() is not None

    def aggregate(self, depth: int) -> DependencyGraph:
        """Directories of at most `depth` components in the place of files; edges within one stay as loops."""
        at = lambda c: P.directory(c, depth).alias(c)
        return DependencyGraph.from_edges(self.paths.select(at("path")), self.edges.select(at("src"), at("dst"), "kind", "count"))

    def ordered_edges(self) -> DataFrame:
        """Edges as they are published: by src, dst and the order of kinds."""
        return self.edges.orderBy("src", "dst", kind_order(F.col("kind")))


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out == 0, F.lit(0.0)).otherwise(fan_out / (fan_in + fan_out))


def _fans(rows: DataFrame, *more: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in (*more, "fan_in", "fan_out")]
    return rows.groupBy("path").agg(*sums).withColumn("instability", instability(F.col("fan_in"), F.col("fan_out")))


def file_coupling(g: DependencyGraph) -> DataFrame:
    """path, fan_in, fan_out, instability of every file; a file's import of itself does not count."""
    ends = F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("fan_in"), F.lit(0).alias("fan_out")), F.struct(F.col("src").alias("path"), F.lit(0).alias("fan_in"), F.lit(1).alias("fan_out")))
    rows = g.pairs().where("src <> dst").select(F.inline(ends))
    return _fans(rows.unionByName(g.paths.select("path", F.lit(0).alias("fan_in"), F.lit(0).alias("fan_out"))))


def directory_coupling(g: DependencyGraph) -> DataFrame:
    """path, files, fan_in, fan_out, instability of every directory but the root. A pair of files counts once for each
    directory that holds exactly one of them."""
    up, down = P.ancestors("src"), P.ancestors("dst")
    crossed = g.pairs().select(F.array_except(up, down).alias("out"), F.array_except(down, up).alias("into"))
    row = lambda d, files, i, o: F.struct(d.alias("path"), F.lit(files).alias("files"), F.lit(i).alias("fan_in"), F.lit(o).alias("fan_out"))
    ends = crossed.select(F.inline(F.concat(F.transform("out", lambda d: row(d, 0, 0, 1)), F.transform("into", lambda d: row(d, 0, 1, 0)))))
    held = g.paths.select(F.inline(F.transform(P.ancestors("path"), lambda d: row(d, 1, 0, 0))))
    return _fans(ends.unionByName(held), "files")


def direct(g: DependencyGraph, path: str, dependents: bool = False) -> DataFrame:
    """path: the files that `path` depends upon, or those that depend upon it."""
    known(g, [path])
    near, far = ("dst", "src") if dependents else ("src", "dst")
    return g.edges.where(F.col(near) == path).select(F.col(far).alias("path")).distinct()


def known(g: DependencyGraph, wanted: list[str]) -> None:
    there = {r["path"] for r in g.paths.where(F.col("path").isin(*wanted)).collect()}  # no more rows than were asked for
    if missing := [p for p in wanted if p not in there]:
        raise GraphError(f"UnknownPath: {missing[0]}")


def first_edge(edges: DataFrame, *by: str) -> DataFrame:
    """Of the edges alike in `by` the one of the lowest kind."""
    return edges.groupBy(*by).agg(F.min_by("kind", kind_order(F.col("kind"))).alias("kind"))


def import_edges(found: DataFrame) -> DataFrame:
    """Edges of recovered imports (src, offset, pos, dst, kind): a target counts once at each offset, under the kind of
    the first reference there."""
    first = F.row_number().over(Window.partitionBy("src", "offset", "dst").orderBy("pos"))
    return found.withColumn("_n", first).where("_n = 1").groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("count"))


def link_edges(found: DataFrame) -> DataFrame:
    """Edges of links and asset paths (src, dst, kind): every occurrence counts, loops do not."""
    return found.where("src <> dst").groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("count"))
