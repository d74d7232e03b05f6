"""Fix-points over the distinct pairs (src, dst) of a graph, as joins that repeat until nothing changes.

`distances` walks from given starts, several hops to a round, many walks at once, and carries a row for each node that
a walk reaches. `reach` and `affected` walk only to nodes with several edges in. `components` and `layers` carry a row for each node and edge. `closure` extends
the pairs known already by the longest of them, so lengths double each round; it holds a row for each pair that is
connected, as its answer does, in one round's table at a time. `all_reached` closes only nodes with several edges out, and
nothing else here uses it. Each round ends in a table in the shared folder, so a
lost executor costs a round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_settled, settle, settled
from .graph import DependencyGraph, known

HOPS = 4


def _state(df: DataFrame, measure: str):
    return df.agg(F.count(F.lit(1)), F.sum(measure)).first()


def distances(edges: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """walk, path, dist: the fewest edges (one at least) by which each walk reaches each path from any of its starts.

    edges: src, dst and the walks (an array of numbers) that may follow each; starts: walk and path. All walks go on at
    once, so they take the rounds of the longest, not of their sum."""
    edges = settle(edges.select("src", "dst", "walks"))

    def onward(front: DataFrame) -> DataFrame:
        met = edges.join(front.select("walk", F.col("path").alias("src")), "src").where(F.array_contains("walks", F.col("walk")))
        return met.select("walk", F.col("dst").alias("path")).distinct()

    seen = settle(onward(starts.select("walk", "path").distinct()).withColumn("dist", F.lit(1)))
    before = None
    while (now := _state(seen, "dist")) != before:
        before = now
        # a walk whose end came earlier has no row at the edge, and stays as it is
        edge = seen.agg(F.max("dist")).first()[0]
        front = seen.where(F.col("dist") == edge)
        more = seen
        for h in range(1, hops + 1):
            front = onward(front)
            more = more.unionByName(front.withColumn("dist", F.lit(edge + h if edge else h)))
        seen = settle(more.groupBy("walk", "path").agg(F.min("dist").alias("dist")))
    return seen


def distances_from(pairs: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """path, dist: the fewest edges (one at least) by which each path is reached from any start (column path)."""
    one = distances(pairs.select("src", "dst").withColumn("walks", F.array(F.lit(0))), starts.select(F.lit(0).alias("walk"), "path"), hops)
    return one.select("path", "dist")


def closure(pairs: DataFrame) -> DataFrame:
    """src, dst, dist of all connected pairs: the fewest edges between them.

    After a round all pairs of up to 2 * step edges are known. Each new one is put together of a known pair and one of
    just `step` edges, so once for each way in the middle and not once for each place to cut it."""
    now, path = settled(pairs.select("src", "dst").distinct().withColumn("dist", F.lit(1)))
    step = 1
    while now.where(F.col("dist") == step).head() is not None:
        a, b = now.select("src", F.col("dst").alias("mid"), F.col("dist").alias("d1")), now.where(F.col("dist") == step).select(F.col("src").alias("mid"), "dst")
        two = a.join(b, "mid").groupBy("src", "dst").agg((F.min("d1") + F.lit(step)).alias("dist"))
        last = path
        now, path = settled(now.unionByName(two.join(now.select("src", "dst"), ["src", "dst"], "left_anti")))
        drop_settled(pairs.sparkSession, last)  # all pairs are in the new round's table, nothing reads the old one's again
        step *= 2
    return now


def all_reached(pairs: DataFrame) -> DataFrame:
    """src, dst of all connected pairs, each once.

    A node with one edge out, to another, goes on as that one does, down to the first node that is none such, its top,
    and what it reaches is the way there and what the top reaches. So only tops are closed, and what each of them reaches
    is a table; the pairs of all others are made as the answer is read, and are never on disk as such."""
    pairs = settle(pairs.select("src", "dst").distinct(), "edges")
    one = settle(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).where("n = 1 and src <> dst").select("src", "dst"), "one")
    passed = one.select(F.col("src").alias("dst"))
    way = closure(one).select("src", "dst")
    ends = settle(way.join(passed, "dst", "left_anti").select("src", F.col("dst").alias("top")), "ends")  # none where ways end in a ring
    out = settle(pairs.join(one.select("src"), "src", "left_anti"), "out")
    # from top to top, and what is passed on the way
    next_ = out.join(ends.select(F.col("src").alias("dst"), "top"), "dst").select("src", F.col("top").alias("dst"))
    tops = closure(next_.unionByName(out.join(passed, "dst", "left_anti").select("src", "dst"))).select("src", "dst")
    on = out.select("src", F.col("dst").alias("mid")).join(way.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    between = settle(out.select("src", "dst").unionByName(on).join(passed, "dst", "left_semi").select("src", "dst").distinct(), "between")
    further = tops.select("src", F.col("dst").alias("mid")).join(between.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    reached = settle(between.unionByName(further).distinct().unionByName(tops), "reached")
    own = way.join(ends, "src", "left").select("src", "dst", "top")
    own = settle(own.join(reached.select(F.col("src").alias("top"), "dst"), ["top", "dst"], "left_anti").select("src", "dst"), "own")
    rest = ends.join(reached.select(F.col("src").alias("top"), "dst"), "top").select("src", "dst")
    return reached.unionByName(own).unionByName(rest)


def reach(g: DependencyGraph, starts: list[str], dependents: bool = False, follow: Column | None = None, passable: Column | None = None) -> DataFrame:
    """path: what is reached from the starts by one edge or more; a start only if a chain returns to it.

    follow: a predicate on src, dst, kind, count of the edges that may be taken; passable: one on path of the nodes that
    may be passed: others are reached, and nothing by way of them. Starts are left whatever they are."""
    known(g, starts)
    if follow is not None:
        g = DependencyGraph(g.paths, g.edges.where(follow))
    if passable is not None:
        near = "dst" if dependents else "src"
        open_ = g.paths.where(passable | F.col("path").isin(*starts)).select(F.col("path").alias(near))
        g = DependencyGraph(g.paths, g.edges.join(open_, near, "left_semi"))
    return _reached(g, starts, dependents).select("path")


def _reached(g: DependencyGraph, starts: list[str], dependents: bool) -> DataFrame:
    """path: what is reached by one edge or more.

    A node with one edge in, from u, is reached if u is. Such nodes hang below the first that is none, found by pointers
    twice as far each round; only the others are walked to, by edges from where their sources hang."""
    pairs = g.pairs()
    if dependents:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = settle(pairs, "edges")
    a_start = F.col("path").isin(*starts)
    own = g.paths.where(a_start).select("path")
    into = pairs.where((F.col("src") != F.col("dst")) & ~F.col("dst").isin(*starts))  # starts are left in any case
    hung = _hung(into)
    many = into.join(hung.select(F.col("path").alias("dst")), "dst", "left_anti")
    many = many.join(hung.select(F.col("path").alias("src"), "top"), "src", "left").select(F.coalesce("top", "src").alias("src"), "dst")
    walked = settle(distances_from(many.where("src <> dst").distinct(), own).select("path").unionByName(own))
    every = settle(walked.unionByName(hung.join(walked.select(F.col("path").alias("top")), "top", "left_semi").select("path")))
    back = pairs.where(F.col("dst").isin(*starts)).join(every.select(F.col("path").alias("src")), "src", "left_semi")
    return every.where(~a_start).unionByName(back.select(F.col("dst").alias("path")).distinct())


def _hung(edges: DataFrame) -> DataFrame:
    """path, top of every node with one edge in: the first node above it that has none or several. Below a ring of such
    nodes there is none; top is then one of the ring."""
    one = edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("top")).where("n = 1")
    now = settle(one.select("path", "top", F.lit(True).alias("open")), "hung")
    before = None
    # in each round some end, up to twice as far from the top, but for what goes round in rings
    while (left := now.where("open").count()) not in (0, before):
        before = left
        above = now.select(F.col("path").alias("top"), F.col("top").alias("_t"), F.col("open").alias("_o"))
        on = now.where("open").drop("open").join(above, "top", "left")
        on = on.select("path", F.coalesce("_t", "top").alias("top"), F.coalesce("_o", F.lit(False)).alias("open"))
        now = settle(now.where("not open").unionByName(on), "hung")
    return now.select("path", "top")


def affected(g: DependencyGraph, changed: list[str]) -> DataFrame:
    """path: the changed files that are known, and all that depend upon them."""
    own = g.paths.where(F.col("path").isin(*changed)).select("path")
    return _reached(g, changed, True).select("path").unionByName(own).distinct()


def components(g: DependencyGraph) -> DataFrame:
    """path, component: the least path of the strongly connected component that holds it.

    Chains of nodes with one edge in and one out are drawn together first, by pointers twice as far each round. Of what
    is left every node learns the least node that reaches it and the least that it reaches, in a fixed hash order. Where
    the two are one, all nodes that have it are a component; edges between nodes that differ in either can be in none
    and go. The rest is labelled anew, until no edge is left. Labels move along edges and by jumps (what reaches my
    label reaches me). Rows are as many as nodes and edges, whatever is connected with what.
    """
    # a hash in front makes the order independent of the names, which chains of files often follow
    name = lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit(":"), F.col(c))
    edges = settle(g.pairs().where("src <> dst").select(name("src").alias("u"), name("dst").alias("v")), "edges")
    links = _links(edges)
    held = links.select("id")
    bare = edges.join(held.withColumnRenamed("id", "u"), "u", "left_anti").join(held.withColumnRenamed("id", "v"), "v", "left_anti").select("u", "v")
    edges = settle(bare.unionByName(links.where("not ring and top <> bottom").select(F.col("top").alias("u"), F.col("bottom").alias("v"))).distinct(), "edges")
    found = [links.where("ring").select("id", F.col("low").alias("root"))]
    solved = None
    while edges.head() is not None:
        labels = _least_around(edges)
        own = labels.where("fwd = bwd").select("id", F.col("fwd").alias("root"))
        solved = own if solved is None else solved.unionByName(own)
        open_ = labels.where("fwd <> bwd")
        u, v = (open_.select(F.col("id").alias(c), "fwd", "bwd") for c in "uv")
        edges = settle(edges.join(u, "u").join(v, ["v", "fwd", "bwd"]).select("u", "v"), "edges")
    chains_ = links.where("not ring").select("id", "top", "bottom")
    if solved is not None:
        # a chain is in the component that both of its ends are in
        solved = settle(solved, "roots")
        found.append(solved)
        for c, r in (("top", "a"), ("bottom", "b")):
            chains_ = chains_.join(solved.select(F.col("id").alias(c), F.col("root").alias(r)), c, "left").withColumn(r, F.coalesce(r, c))
    else:
        chains_ = chains_.withColumn("a", F.col("top")).withColumn("b", F.col("bottom"))
    within = chains_.where("a = b")
    found.append(within.select("id", F.col("a").alias("root")).unionByName(within.select(F.col("top").alias("id"), F.col("a").alias("root"))))
    members = reduce(DataFrame.unionByName, found).distinct().withColumn("path", F.expr("substring(id, instr(id, ':') + 1)"))
    members = settle(members, "members")
    least = members.groupBy("root").agg(F.min("path").alias("component"))
    inside = members.join(least, "root").select("path", "component")
    return g.paths.join(inside.hint("merge"), "path", "left").select("path", F.coalesce("component", "path").alias("component"))


def _links(edges: DataFrame) -> DataFrame:
    """id, top, bottom, low, ring of every node with one edge in and one out: the ends of its chain, the first nodes
    that are none such, or, where all of a ring are, ring and the least node of it."""
    one = lambda id_, n_in, up, n_out, down: F.struct(F.col(id_).alias("id"), F.lit(n_in).alias("n_in"), up.alias("up"), F.lit(n_out).alias("n_out"), down.alias("down"))
    none = F.lit(None).cast("string")
    ends = edges.select(F.inline(F.array(one("u", 0, none, 1, F.col("v")), one("v", 1, F.col("u"), 0, none))))
    sums = ends.groupBy("id").agg(F.sum("n_in").alias("i"), F.sum("n_out").alias("o"), F.min("up").alias("top"), F.min("down").alias("bottom")).where("i = 1 and o = 1")
    now = settle(sums.select("id", "top", "bottom", F.col("id").alias("low"), F.lit(True).alias("ring"), F.lit(True).alias("lower")), "links")
    before = None
    while True:
        up = now.select(F.col("id").alias("top"), F.col("top").alias("_t"))
        down = now.select(F.col("id").alias("bottom"), F.col("bottom").alias("_b"), F.col("low").alias("_l"))
        both = now.select("id", "top", "bottom", "low").join(up, "top", "left").join(down, "bottom", "left")
        both = both.select("id", F.coalesce("_t", "top").alias("top"), F.coalesce("_b", "bottom").alias("bottom"), F.least("low", "_l").alias("low"), F.col("_b").isNotNull().alias("ring"), (F.col("_l") < F.col("low")).alias("lower"))
        now = settle(both, "links")
        state = now.agg(F.sum(F.col("ring").cast("int")), F.max(F.col("ring") & F.coalesce("lower", F.lit(False)))).first()
        # pointers that still move though no chain ended and no least changed go round in rings
        if not state[0] or (state[0] == before and not state[1]):
            return now.drop("lower")
        before = state[0]


def _least_around(edges: DataFrame) -> DataFrame:
    """id, fwd, bwd of every node on an edge (u, v): the least node that reaches it and the least that it reaches."""
    none = F.lit(None).cast("string")
    now = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("fwd"), F.col("id").alias("bwd"))
    now = settle(now.withColumn("changed", F.lit(True)), "labels")
    while now.where("changed").head() is not None:
        f = lambda c, of="true": now.where(of).select(F.col("id").alias(c), F.col("fwd").alias("f"))
        b = lambda c, of="true": now.where(of).select(F.col("id").alias(c), F.col("bwd").alias("b"))
        said = [
            now.select("id", F.col("fwd").alias("f"), F.col("bwd").alias("b"), F.struct("fwd", "bwd").alias("old")),
            edges.join(f("u", "changed"), "u").select(F.col("v").alias("id"), "f", none.alias("b")).where("f < id"),
            edges.join(b("v", "changed"), "v").select(F.col("u").alias("id"), none.alias("f"), "b").where("b < id"),
            now.where("fwd < id").join(f("fwd"), "fwd").select("id", "f", none.alias("b")),
            now.where("bwd < id").join(b("bwd"), "bwd").select("id", none.alias("f"), "b"),
        ]
        said = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), said)
        least = said.groupBy("id").agg(F.min("f").alias("fwd"), F.min("b").alias("bwd"), F.max("old").alias("old"))
        now = settle(least.select("id", "fwd", "bwd", ((F.col("fwd") != F.col("old.fwd")) | (F.col("bwd") != F.col("old.bwd"))).alias("changed")), "labels")
    return now.drop("changed")


def layers(g: DependencyGraph, comps: DataFrame | None = None) -> DataFrame:
    """path, depth: the longest way down from a component that no other imports; members share it.

    A component with one importer lies one below it, so chains of such are followed by pointers twice as far each
    round; only components with several importers are relaxed level by level, over the edges of those that changed."""
    comps = settle(components(g) if comps is None else comps)
    src, dst = comps.select(F.col("path").alias("src"), F.col("component").alias("a")), comps.select(F.col("path").alias("dst"), F.col("component").alias("b"))
    between = settle(g.pairs().join(src, "src").join(dst, "dst").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    into = settle(between.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("top")))
    # below: v lies `down` edges below top, and on no other way
    below = settle(into.where("n = 1").select("v", "top", F.lit(1).alias("down"), F.lit(True).alias("moved")))
    while below.where("moved").head() is not None:
        above = below.select(F.col("v").alias("top"), F.col("top").alias("higher"), F.col("down").alias("more"))
        below = settle(below.join(above, "top", "left").select("v", F.coalesce("higher", "top").alias("top"), (F.col("down") + F.coalesce("more", F.lit(0))).alias("down"), F.col("higher").isNotNull().alias("moved")))
    many = between.join(into.where("n > 1").select("v"), "v", "left_semi")
    hung = below.select(F.col("v").alias("u"), "top", "down")
    weights = many.join(hung, "u", "left").groupBy(F.coalesce("top", "u").alias("u"), "v").agg((F.max(F.coalesce("down", F.lit(0))) + 1).alias("w"))
    weights = settle(weights)
    deep = settle(weights.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.lit(0).alias("depth"), F.lit(True).alias("changed")))
    while deep.where("changed").head() is not None:
        more = weights.join(deep.where("changed").select(F.col("id").alias("u"), "depth"), "u").groupBy(F.col("v").alias("id")).agg((F.max(F.col("depth") + F.col("w"))).alias("d"))
        deep = settle(deep.join(more, "id", "left").select("id", F.greatest("depth", "d").alias("depth"), F.coalesce(F.col("d") > F.col("depth"), F.lit(False)).alias("changed")))
    at = deep.select(F.col("id").alias("component"), "depth")
    under = below.join(at.withColumnRenamed("component", "top"), "top", "left").select(F.col("v").alias("component"), (F.coalesce("depth", F.lit(0)) + F.col("down")).alias("depth"))
    depth = under.unionByName(at.join(under.select("component"), "component", "left_anti"))
    return comps.join(depth, "component", "left").select("path", F.coalesce("depth", F.lit(0)).alias("depth"))


def shared_chains(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """walk, path, chain: of each walk, from each of its starts, the shortest way of one edge or more to the nearest of
    its targets, at each step to the lowest path. Starts that reach none are left out.

    edges: src, dst and the walks that may follow each; starts and targets: walk and path. One fix-point serves all."""
    edges = settle(edges.select("src", "dst", "walks"))
    targets = targets.select("walk", "path").distinct()
    far = distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "walks"), targets)
    dist = targets.select("walk", "path", F.lit(0).alias("dist")).unionByName(far).groupBy("walk", "path").agg(F.min("dist").alias("dist"))
    met = edges.join(dist.withColumnRenamed("path", "dst"), "dst").where(F.array_contains("walks", F.col("walk")))
    hop = settle(met.groupBy("walk", "src").agg(F.min(F.struct("dist", "dst")).alias("m")).select("walk", "src", F.col("m.dst").alias("next"), (F.col("m.dist") == 0).alias("done")))
    # ways between targets, twice as long each round; those that are at a target meet nothing, as one target may be the
    # end of most of them
    way = hop.join(targets.withColumnRenamed("path", "src"), ["walk", "src"], "left_anti").select("walk", "src", F.array("next").alias("way"), F.col("next").alias("end"), "done")
    way = settle(way)
    while way.where("not done").head() is not None:
        more = way.select("walk", F.col("src").alias("end"), F.col("way").alias("on"), F.col("end").alias("last"), F.col("done").alias("there"))
        longer = way.where("not done").join(more, ["walk", "end"])
        way = settle(way.where("done").unionByName(longer.select("walk", "src", F.concat("way", "on").alias("way"), F.col("last").alias("end"), F.col("there").alias("done"))))
    first = starts.select("walk", F.col("path").alias("src")).distinct().join(hop.drop("done"), ["walk", "src"])
    rest = way.select("walk", F.col("src").alias("next"), "way")
    empty = F.array().cast("array<string>")
    return first.join(rest, ["walk", "next"], "left").select("walk", F.col("src").alias("path"), F.concat(F.array("src", "next"), F.coalesce("way", empty)).alias("chain"))


def chains(pairs: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """path, chain: shared_chains() of one walk."""
    edges = pairs.select("src", "dst").distinct().withColumn("walks", F.array(F.lit(0)))
    one = lambda df: df.select(F.lit(0).alias("walk"), "path")
    return shared_chains(edges, one(starts), one(targets)).select("path", "chain")


def chain(g: DependencyGraph, start: str, end: str) -> DataFrame:
    """chain: the shortest, lowest walk from start to end; no row if there is none."""
    known(g, [start, end])
    one = lambda p: g.paths.where(F.col("path") == p)
    pairs = settle(g.pairs())
    # what the start does not reach is on no way of its own, however much reaches the end
    near = distances_from(pairs, one(start)).select("path").unionByName(one(start)).distinct()
    around = settle(pairs.join(near.select(F.col("path").alias("src")).hint("merge"), "src", "left_semi"))
    return chains(around, one(start), one(end)).select("chain")


def cycles(g: DependencyGraph, comps: DataFrame | None = None) -> DataFrame:
    """component, members (sorted), walk: of each component with a cycle one closed walk. It starts at the lowest member,
    goes to its lowest successor within, and returns by the shortest, lowest way."""
    comps = settle(components(g) if comps is None else comps)
    src, dst = comps.select(F.col("path").alias("src"), F.col("component").alias("a")), comps.select(F.col("path").alias("dst"), F.col("component").alias("b"))
    inside = settle(g.pairs().join(src, "src").join(dst, "dst").where("a = b").select("src", "dst", F.col("a").alias("component")))
    first = inside.where("src = component").groupBy("component").agg(F.min("dst").alias("second"))
    ways = chains(inside.select("src", "dst"), first.where("second <> component").select(F.col("second").alias("path")), first.select(F.col("component").alias("path")))
    members = comps.join(first, "component", "left_semi").groupBy("component").agg(F.sort_array(F.collect_list("path")).alias("members"))
    walks = first.join(ways.withColumnRenamed("path", "second"), "second", "left")
    walk = F.when(F.col("second") == F.col("component"), F.array("component", "second")).otherwise(F.concat(F.array("component"), F.col("chain")))
    return members.join(walks, "component").select("component", "members", walk.alias("walk"))
