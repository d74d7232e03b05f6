"""Declarative rules over a graph, each a filter, a semi or anti join, or a fix-point. Findings are rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..sources.shared import settle
from . import dependencies, iterate
from .graph import DependencyGraph, first_edge, kind_order

FINDING = ("rule_ord", "rule", "reason", "path", "src", "dst", "kind", "name", "chain", "offset")
_TYPES = dict(rule_ord="int", rule="string", reason="string", path="string", src="string", dst="string", kind="string", name="string", chain="array<string>", offset="long")


@dataclass(frozen=True)
class Allow:
    """Exempts edges from the rule of this name."""

    rule: str
    source: str = "**"
    target: str = "**"
    kind: str | None = None


@dataclass(frozen=True)
class OrderedLayers:
    """layers: patterns of each layer, the lowest first. A file may depend upon its own layer and those below."""

    name: str
    layers: tuple[tuple[str, ...], ...]
    default_layer: int = 0
    transitive: bool = False


@dataclass(frozen=True)
class EdgeRule:
    name: str
    source: str
    target: str
    kind: str | None = None
    transitive: bool = False


@dataclass(frozen=True)
class NothingImports:
    name: str
    target: str


@dataclass(frozen=True)
class ReferenceRule:
    """target: a pattern of names as references spell them."""

    name: str
    target: str
    member: str | None = None
    kind: str | None = None
    unresolved_only: bool = False
    relative: bool = False
    suffix: str = ""
    except_targets: tuple[str, ...] = ()
    except_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class TokenRule:
    """patterns of tokens that only their owners may spell. kind: identifier, string or sequence."""

    name: str
    patterns: tuple[str, ...]
    kind: str = "identifier"
    owners: tuple[str, ...] = ()


@dataclass(frozen=True)
class Required:
    name: str
    path: str


@dataclass(frozen=True)
class NoCycles:
    name: str


@dataclass(frozen=True)
class Reachable:
    name: str
    files: str
    entries: tuple[str, ...]
    kind: str | None = None


@dataclass(frozen=True)
class DependencyRule:
    """Imports and declarations of one ecosystem. unused: scopes whose declarations some file has to import; ignore:
    packages that are left out, by full or short name; aliases: (imported, declared) names of one package."""

    name: str
    ecosystem: str
    undeclared: bool = True
    unused: tuple[str, ...] = ("runtime",)
    ignore: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rules:
    ordered: tuple[OrderedLayers, ...] = ()
    forbidden: tuple[EdgeRule, ...] = ()
    allowed: tuple[Allow, ...] = ()
    nothing_imports: tuple[NothingImports, ...] = ()
    references: tuple[ReferenceRule, ...] = ()
    tokens: tuple[TokenRule, ...] = ()
    required: tuple[Required, ...] = ()
    no_cycles: tuple[NoCycles, ...] = ()
    reachable: tuple[Reachable, ...] = field(default=())
    dependencies: tuple[DependencyRule, ...] = field(default=())


def _finding(df: DataFrame, rule: str, reason: str, /, **columns: Column | str) -> DataFrame:
    given = {"rule_ord": F.lit(0), "rule": F.lit(rule), "reason": F.lit(reason)} | {k: F.col(c) if isinstance(c, str) else c for k, c in columns.items()}
    return df.select(*(given.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in FINDING))


def _follows(rule: str, kind: str | None, allowed: tuple[Allow, ...]) -> Column:
    """Whether a rule looks at an edge (src, dst, kind): it is of its kind and not exempt from it."""
    out = F.lit(True) if kind is None else F.col("kind") == kind
    for a in (a for a in allowed if a.rule == rule):
        exempt = globs.matches(F.col("src"), a.source) & globs.matches(F.col("dst"), a.target)
        out = out & ~(exempt if a.kind is None else exempt & (F.col("kind") == a.kind))
    return out


def _kept(edges: DataFrame, rule: str, kind: str | None, allowed: tuple[Allow, ...]) -> DataFrame:
    return edges.where(_follows(rule, kind, allowed))


@dataclass(frozen=True)
class Walk:
    """What a transitive rule asks: the edges (src, dst, kind) that it follows, and the paths it starts from and looks for."""

    follow: Column
    starts: Column
    targets: Column


def walked(g: DependencyGraph, walks: list[Walk]) -> DataFrame:
    """walk (its number), path, chain, and src, dst, kind of the chain's first edge, of its lowest kind; of all walks in
    one fix-point."""

    def of(conditions: list[Column]) -> Column:
        return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in enumerate(conditions))), lambda n: n.isNotNull())

    marked = settle(g.edges.select("src", "dst", "kind", of([w.follow for w in walks]).alias("walks")).where(F.size("walks") > 0), "marked")
    edges = marked.groupBy("src", "dst").agg(F.array_distinct(F.flatten(F.collect_set("walks"))).alias("walks"))  # one set a kind at most
    at = lambda conditions: g.paths.select("path", F.explode(of(conditions)).alias("walk"))
    found = iterate.shared_chains(edges, at([w.starts for w in walks]), at([w.targets for w in walks]))
    first = first_edge(marked.select("src", "dst", "kind", F.explode("walks").alias("walk")), "src", "dst", "walk")
    return found.withColumn("src", F.col("chain")[0]).withColumn("dst", F.col("chain")[1]).join(first, ["src", "dst", "walk"])


def layer_of(path: Column, rule: OrderedLayers) -> Column:
    """The number of the first layer that has a pattern for the path, or null."""
    return F.coalesce(*(F.when(globs.any_of(path, patterns), F.lit(n)) for n, patterns in enumerate(rule.layers)), F.lit(None).cast("int"))


def _ordered_walks(rule: OrderedLayers, allowed: tuple[Allow, ...]) -> list[Walk]:
    """Of each layer but the lowest one walk: from lower layers, by files of no layer or a lower one, to files of it."""
    a, b, at = layer_of(F.col("src"), rule), layer_of(F.col("dst"), rule), layer_of(F.col("path"), rule)
    kept = _follows(rule.name, None, allowed)
    return [Walk(kept & (a.isNull() | (a < n)) & (b.isNull() | (b == n)), at < n, at == n) for n in range(1, len(rule.layers))]


def _chain_findings(found: DataFrame, numbers: list[int], rule: str, reason: str) -> DataFrame:
    return _finding(found.where(F.col("walk").isin(*numbers)), rule, reason, src="src", dst="dst", kind="kind", chain="chain")


def ordered(g: DependencyGraph, rule: OrderedLayers, allowed: tuple[Allow, ...] = ()) -> DataFrame:
    edges = _kept(g.edges, rule.name, None, allowed)
    if not rule.transitive:
        at = lambda c: F.coalesce(layer_of(F.col(c), rule), F.lit(rule.default_layer))
        return _finding(edges.where(at("dst") > at("src")), rule.name, "upward", src="src", dst="dst", kind="kind")
    walks = _ordered_walks(rule, allowed)
    return _chain_findings(walked(g, walks), list(range(len(walks))), rule.name, "upward") if walks else _finding(edges.limit(0), rule.name, "upward")


def _forbidden_walk(rule: EdgeRule, allowed: tuple[Allow, ...]) -> Walk:
    return Walk(_follows(rule.name, rule.kind, allowed), globs.matches(F.col("path"), rule.source), globs.matches(F.col("path"), rule.target))


def forbidden(g: DependencyGraph, rule: EdgeRule, allowed: tuple[Allow, ...] = ()) -> DataFrame:
    if not rule.transitive:
        edges = _kept(g.edges, rule.name, rule.kind, allowed)
        return _finding(edges.where(globs.matches(F.col("src"), rule.source) & globs.matches(F.col("dst"), rule.target)), rule.name, "forbidden", src="src", dst="dst", kind="kind")
    return _chain_findings(walked(g, [_forbidden_walk(rule, allowed)]), [0], rule.name, "forbidden")


def nothing_imports(g: DependencyGraph, rule: NothingImports, allowed: tuple[Allow, ...] = ()) -> DataFrame:
    return _finding(_kept(g.edges, rule.name, None, allowed).where(globs.matches(F.col("dst"), rule.target)), rule.name, "entry", src="src", dst="dst", kind="kind")


def references(found: DataFrame, rule: ReferenceRule) -> DataFrame:
    """found: src, pos, name, member, kind, resolved of every reference."""
    spelled = F.col("name")
    if rule.relative:
        spelled = F.coalesce(paths.joined(paths.dirname("src"), spelled), spelled)
    if rule.suffix:
        found = found.where(F.endswith(F.col("name"), F.lit(rule.suffix)))
    found = found.where(globs.matches(spelled, rule.target, anywhere=False)).where(F.col("member").isNull() if rule.member is None else F.col("member") == rule.member)
    if rule.unresolved_only:
        found = found.where(~F.col("resolved"))
    if rule.kind is not None:
        found = found.where(F.col("kind") == rule.kind)
    found = found.where(~globs.any_of(spelled, rule.except_targets, anywhere=False) & ~globs.any_of(F.col("src"), rule.except_from))
    return _finding(found, rule.name, "reference", path="src", name="name", kind="kind", offset="pos")


def tokens(found: DataFrame, rule: TokenRule) -> DataFrame:
    """found: path, kind, text, offset of every recorded token."""
    match = globs.matches_sequence if rule.kind == "sequence" else globs.matches_token
    hit = reduce(lambda a, b: a | b, (match(F.col("text"), p) for p in rule.patterns))
    return _finding(found.where(F.col("kind") == rule.kind).where(hit & ~globs.any_of(F.col("path"), rule.owners)), rule.name, "token", path="path", name="text", offset="offset")


def required(g: DependencyGraph, rules: tuple[Required, ...]) -> DataFrame:
    wanted = g.paths.sparkSession.createDataFrame([(r.name, r.path) for r in rules], "rule string, path string")
    return _finding(wanted.join(g.paths, "path", "left_anti"), "", "missing", rule="rule", path="path")


def no_cycles(g: DependencyGraph, rule: NoCycles) -> DataFrame:
    """One finding a cycle, with the lowest edge between the first two files of its walk."""
    walks = iterate.cycles(g).select(F.col("walk")[0].alias("src"), F.col("walk")[1].alias("dst"), F.col("walk").alias("chain"))
    return _finding(walks.join(first_edge(g.edges, "src", "dst"), ["src", "dst"]), rule.name, "cycle", src="src", dst="dst", kind="kind", chain="chain")


def reachable(g: DependencyGraph, rule: Reachable) -> DataFrame:
    """Files of the rule that no entry reaches; entries are reached."""
    edges = g.edges if rule.kind is None else g.edges.where(F.col("kind") == rule.kind)
    entries = g.paths.where(globs.any_of(F.col("path"), rule.entries))
    seen = iterate.distances_from(edges.select("src", "dst").distinct(), entries).select("path").unionByName(entries)
    return _finding(g.paths.where(globs.matches(F.col("path"), rule.files)).join(seen, "path", "left_anti"), rule.name, "unreached", path="path")


def dependency(refs: DataFrame, declared: DataFrame, rule: DependencyRule) -> DataFrame:
    """refs: src, pos, name, resolved; declared: rows of the manifest readers."""
    # both are read several times, and long expressions end here
    refs, declared = settle(refs, "references"), settle(declared, "declared")
    uses = settle(dependencies.used(refs, declared, rule.ecosystem, rule.aliases), "uses")
    unused = dependencies.unused(uses, declared, rule.ecosystem, rule.unused, rule.ignore)
    found = _finding(unused, rule.name, "unused", path="manifest", name="name")
    if rule.undeclared:
        found = found.unionByName(_finding(dependencies.undeclared(uses, rule.ignore), rule.name, "undeclared", path="src", name="package", offset="pos"))
    return found


def check(g: DependencyGraph, rules: Rules, refs: DataFrame | None = None, toks: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Findings of all rules. Patterns are compiled first, so a wrong one stops before any work."""
    if rules.references and refs is None or rules.tokens and toks is None:
        raise ValueError("UnscannedToken: the scan recorded no such rows")
    if rules.dependencies and (refs is None or declared is None):
        raise ValueError("UnscannedManifests: the scan read no declarations")
    # all transitive rules walk together
    asked = [(r, w) for r in rules.ordered if r.transitive for w in _ordered_walks(r, rules.allowed)]
    asked += [(r, _forbidden_walk(r, rules.allowed)) for r in rules.forbidden if r.transitive]
    ways = settle(walked(g, [w for _, w in asked]), "walks") if asked else None

    def findings(rule: OrderedLayers | EdgeRule, alone, reason: str) -> DataFrame:
        numbers = [n for n, (r, _) in enumerate(asked) if r is rule]
        return _chain_findings(ways, numbers, rule.name, reason) if numbers else alone(g, rule, rules.allowed)

    found: list[DataFrame] = [findings(r, ordered, "upward") for r in rules.ordered]
    found += [findings(r, forbidden, "forbidden") for r in rules.forbidden]
    found += [nothing_imports(g, r, rules.allowed) for r in rules.nothing_imports]
    found += [references(refs, r) for r in rules.references]
    found += [tokens(toks, r) for r in rules.tokens]
    found += [required(g, rules.required)] if rules.required else []
    found += [no_cycles(g, r) for r in rules.no_cycles]
    found += [reachable(g, r) for r in rules.reachable]
    found += [dependency(refs, declared, r) for r in rules.dependencies]
    if not found:
        return _finding(g.paths.limit(0), "", "")
    return reduce(DataFrame.unionByName, (f.withColumn("rule_ord", F.lit(n)) for n, f in enumerate(found)))


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule_ord", "src", "dst", kind_order(F.col("kind")), "path", "name")
