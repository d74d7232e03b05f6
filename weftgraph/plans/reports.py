"""Drawings and reports as ordered lines: part, ord and line of each, written as text in that order.

Lines are made by columns, node numbers by ranges: no row passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import paths as P
from ..operators.graph import DependencyGraph, kind_order
from ..sources.shared import settle

# How kinds of edges are drawn.
DOT_STYLES = {"type_only": "style=dashed", "dynamic": "style=dotted", "test": "arrowhead=onormal", "link": "style=dashed, arrowhead=vee", "asset": "style=dotted, arrowhead=odot"}
MERMAID_ARROWS = {"import": "-->", "type_only": "-.->|type_only|", "dynamic": "-.->|dynamic|", "test": "-->|test|", "link": "-.->|link|", "asset": "-.->|asset|"}
RED = "#cc0000"
MARK = f'color="{RED}", penwidth=2'
NODE_MARK = f'color="{RED}", fontcolor="{RED}", penwidth=2'


def positions(df: DataFrame, by: str) -> DataFrame:
    """df with `position`, the place of each row in the order of the column `by` (unique), from 0. Ranges are sorted
    apart and only their sizes, one a partition, come together."""
    rows = settle(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}  # one row a partition
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    joined = rows.withColumn("_p", part.cast("long")).join(F.broadcast(offsets), "_p")
    return joined.withColumn("position", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, "position")


def _lines(df: DataFrame, part: int, order: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), order.cast("string").alias("ord"), line.alias("line"))


def _fixed(g: DependencyGraph, part: int, line: str) -> DataFrame:
    return _lines(g.paths.sparkSession.range(1), part, F.lit(""), F.lit(line))


def quoted(c: Column) -> Column:
    """A JSON string, which DOT reads too."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def marks(findings: DataFrame | None, g: DependencyGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes that findings name, and edges: of the same kind, or of every kind along a chain."""
    if findings is None:
        none = g.edges.limit(0)
        return none.select(F.col("src").alias("path")), none.select("src", "dst", "kind")
    nodes = findings.select(F.explode(F.concat(F.array("path", "src", "dst"), F.coalesce("chain", F.array().cast("array<string>")))).alias("path")).where("path is not null").distinct()
    steps = findings.where("chain is not null").select(F.explode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("src"), F.slice("chain", F.lit(2), F.size("chain")).alias("dst"))).alias("s")).select("s.src", "s.dst").distinct()
    own = findings.where("chain is null and src is not null").select("src", "dst", "kind")
    return nodes, own.unionByName(g.edges.join(steps, ["src", "dst"], "left_semi").select("src", "dst", "kind")).distinct()


def _styled(styles: dict[str, str], other: str) -> Column:
    return reduce(lambda out, kv: F.when(F.col("kind") == kv[0], F.lit(kv[1])).otherwise(out), styles.items(), F.lit(other))


def _edge_order() -> Column:
    return F.concat_ws("\u0000", "src", "dst", kind_order(F.col("kind")).cast("string"))


#: What sorts behind everything that a box holds.
LAST = "\U0010ffff"


def boxes(g: DependencyGraph, cluster: str | None, layers: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, key, depth, label) and boxes (key, close, depth, name, label) of a drawing, in the order of their keys.

    cluster: None, "directory" (nested boxes; nodes are labelled with their last component) or "layer" (one box for each
    of layers, (name, patterns), that has nodes; a path is in the first that has a pattern for it, the others come last).
    A box opens at its key and closes at `close`: keys are made of the paths alone, so nesting needs no stack."""
    if cluster == "layer":
        last = len(layers)
        at = F.coalesce(*(F.when(globs.any_of(F.col("path"), patterns), F.lit(n)) for n, (_, patterns) in enumerate(layers)), F.lit(last))
        rank = lambda c: F.lpad(c.cast("string"), 6, "0")
        own = g.paths.withColumn("layer", at)
        nodes = own.select("path", F.concat(rank(F.col("layer")), F.lit("/"), "path").alias("key"), F.when(F.col("layer") == last, 0).otherwise(1).alias("depth"), F.lit(None).cast("string").alias("label"))
        names = F.get(F.array(*(F.lit(n) for n, _ in layers), F.lit("")), F.col("layer"))
        used = own.where(F.col("layer") < last).select("layer").distinct()
        return nodes, used.select(rank(F.col("layer")).alias("key"), F.concat(rank(F.col("layer")), F.lit("/" + LAST)).alias("close"), F.lit(0).alias("depth"), F.concat(F.lit("layer_"), F.col("layer").cast("string")).alias("name"), names.alias("label"))
    depth = lambda c: F.size(F.split(c, "/")) - 1
    if cluster == "directory":
        held = g.paths.select(F.explode(P.ancestors("path")).alias("d")).distinct()
        opened = held.select(F.concat("d", F.lit("/")).alias("key"), F.concat("d", F.lit("/" + LAST)).alias("close"), depth("d").alias("depth"), F.col("d").alias("name"), P.basename("d").alias("label"))
        return g.paths.select("path", F.col("path").alias("key"), depth("path").alias("depth"), F.when(F.col("path").contains("/"), P.basename("path")).alias("label")), opened
    nodes = g.paths.select("path", F.col("path").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("label"))
    none = nodes.limit(0).select("key", F.col("key").alias("close"), "depth", F.col("key").alias("name"), "label")
    return nodes, none


def _indented(line: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), line)


def dot(g: DependencyGraph, findings: DataFrame | None = None, cluster: str | None = None, layers: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> DataFrame:
    """part, ord, line. cluster and layers: as boxes() has them."""
    nodes, edges = marks(findings, g)
    held, opened = boxes(g, cluster, layers)
    own = held.join(nodes.withColumn("m", F.lit(True)), "path", "left")
    said = F.concat_ws(", ", F.when(F.col("label").isNotNull(), F.concat(F.lit("label="), quoted(F.col("label")))), F.when(F.col("m"), F.lit(NODE_MARK)))
    name = _indented(F.concat(quoted(F.col("path")), F.when(said == "", "").otherwise(F.concat(F.lit(" ["), said, F.lit("]"))), F.lit(";")))
    drawn = g.edges.join(edges.withColumn("m", F.lit(True)), ["src", "dst", "kind"], "left")
    look = F.concat_ws(", ", F.nullif(_styled(DOT_STYLES, ""), F.lit("")), F.when(F.col("m"), F.lit(MARK)))
    arrow = F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.when(look == "", "").otherwise(F.concat(F.lit(" ["), look, F.lit("]"))), F.lit(";"))
    head = F.concat(_indented(F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), F.col("name"))), F.lit(" {"))), F.lit("\n"), _indented(F.concat(F.lit("  label="), quoted(F.col("label")), F.lit(";"))))
    parts = [_fixed(g, 0, "digraph dependencies {\n  rankdir=LR;"), _lines(own, 1, F.col("key"), name)]
    if cluster is not None:
        parts += [_lines(opened, 1, F.col("key"), head), _lines(opened, 1, F.col("close"), _indented(F.lit("}")))]
    parts += [_lines(drawn, 2, _edge_order(), arrow), _fixed(g, 3, "}")]
    return reduce(DataFrame.unionByName, parts)


def mermaid(g: DependencyGraph, findings: DataFrame | None = None, cluster: str | None = None, layers: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> DataFrame:
    """part, ord, line; nodes are numbered in the order of their paths, boxes and edges in that of their lines. Marked
    nodes have a class, and each marked edge a linkStyle with its number."""
    at = positions(g.paths, "path")
    held, opened = boxes(g, cluster, layers)
    named, marked = marks(findings, g)
    own = held.join(at, "path").join(named.withColumn("m", F.lit(True)), "path", "left")
    plain = lambda c: F.regexp_replace(quoted(c), r'\\"', "#quot;")
    label = _indented(F.concat(F.lit("n"), F.col("position").cast("string"), F.lit("["), plain(F.coalesce("label", "path")), F.lit("]"), F.when(F.col("m"), ":::finding").otherwise("")))
    ends = g.edges.join(at.select(F.col("path").alias("src"), F.col("position").alias("a")), "src").join(at.select(F.col("path").alias("dst"), F.col("position").alias("b")), "dst")
    arrow = F.concat(F.lit("  n"), F.col("a").cast("string"), F.lit(" "), _styled(MERMAID_ARROWS, "-->"), F.lit(" n"), F.col("b").cast("string"))
    number = lambda c: F.lpad(c.cast("string"), 19, "0")
    parts = [_fixed(g, 0, "flowchart LR"), _lines(own, 2, F.col("key") if cluster else number(F.col("position")), label), _lines(ends, 3, _edge_order(), arrow)]
    if cluster is not None:
        numbered = positions(opened, "key")
        parts += [_lines(numbered, 2, F.col("key"), _indented(F.concat(F.lit("subgraph d"), F.col("position").cast("string"), F.lit("["), plain(F.col("label")), F.lit("]")))), _lines(numbered, 2, F.col("close"), _indented(F.lit("end")))]
    if findings is not None:
        some = named.limit(1).select(F.lit(1).alias("part"), F.lit("").alias("ord"), F.lit(f"  classDef finding stroke:{RED},stroke-width:2px,color:{RED}").alias("line"))
        order = positions(g.edges.withColumn("_o", _edge_order()), "_o").join(marked, ["src", "dst", "kind"], "left_semi")
        parts += [some, _lines(order, 4, number(F.col("position")), F.concat(F.lit("  linkStyle "), F.col("position").cast("string"), F.lit(f" stroke:{RED},stroke-width:2px")))]
    return reduce(DataFrame.unionByName, parts)


def json_rows(g: DependencyGraph, findings: DataFrame | None = None) -> DataFrame:
    """part, ord, line: one JSON object for each path, edge and finding; null fields are left out."""
    parts = [_lines(g.paths, 0, F.col("path"), F.to_json(F.struct("path"))), _lines(g.edges, 1, _edge_order(), F.to_json(F.struct("src", "dst", "kind", "count")))]
    if findings is not None:
        body = F.struct("rule", "reason", "path", "src", "dst", "kind", "name", "chain")
        parts.append(_lines(findings, 2, F.concat_ws("\u0000", F.lpad(F.col("rule_ord").cast("string"), 6, "0"), "src", "dst", "path", "name"), F.to_json(body)))
    return reduce(DataFrame.unionByName, parts)


def _elements(lines: DataFrame) -> DataFrame:
    """Lines as the elements of one array: a comma before each but the first."""
    return positions(lines, "ord").select("part", "ord", F.concat(F.when(F.col("position") > 0, ",").otherwise(""), "line").alias("line"))


def json_document(g: DependencyGraph, findings: DataFrame | None = None) -> DataFrame:
    """part, ord, line: one JSON document of a fixed layout: format, version, paths, edges and, if asked for, findings."""
    rows = json_rows(g, findings)
    part = lambda old, new: _elements(rows.where(F.col("part") == old).withColumn("part", F.lit(new)))
    quoted_path = _lines(g.paths, 1, F.col("path"), quoted(F.col("path")))
    parts = [_fixed(g, 0, '{"format":"weftgraph","version":1,"paths":['), _elements(quoted_path), _fixed(g, 2, '],"edges":['), part(1, 3)]
    if findings is not None:
        parts += [_fixed(g, 4, '],"findings":['), part(2, 5)]
    return reduce(DataFrame.unionByName, [*parts, _fixed(g, 6, "]}")])


def message() -> Column:
    """What a finding says."""
    edge = F.concat("src", F.lit(" -> "), F.when(F.col("chain").isNotNull(), F.element_at("chain", -1)).otherwise(F.col("dst")))
    walk = F.col("chain").isNotNull()
    return (
        F.when(F.col("reason") == "upward", F.concat(edge, F.when(walk, " reaches a higher layer").otherwise(" goes up a layer")))
        .when(F.col("reason") == "forbidden", F.concat(edge, F.when(walk, " is a forbidden chain").otherwise(" is forbidden")))
        .when(F.col("reason") == "entry", F.concat("src", F.lit(" imports "), "dst", F.lit(", which nothing may import")))
        .when(F.col("reason") == "cycle", F.concat("src", F.lit(" -> "), "dst", F.lit(" is in a cycle")))
        .when(F.col("reason") == "reference", F.concat("path", F.lit(" names "), "name"))
        .when(F.col("reason") == "token", F.concat("name", F.lit(" is spelled outside its owners")))
        .when(F.col("reason") == "missing", F.concat("path", F.lit(" is required and missing")))
        .when(F.col("reason") == "undeclared", F.concat("path", F.lit(" imports "), "name", F.lit(", which its manifest does not declare")))
        .when(F.col("reason") == "unused", F.concat("path", F.lit(" declares "), "name", F.lit(", which nothing imports")))
        .when(F.col("reason") == "unreached", F.concat("path", F.lit(" is reached from no entry")))
    )


def located(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with line and column (from 1, in characters) of their offset in bytes, null where there is none.

    A file's lines and the findings in it are put in one order by their offsets, each finding behind the line that it
    stands in: one pass a file, and no pair of a finding with another line. files: path and text."""
    spot = findings.withColumn("_path", F.coalesce("path", "src")).withColumn("_finding", F.struct(*findings.columns))
    asked = spot.where("offset is not null").select(F.col("_path").alias("p"), F.col("offset").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("string").alias("line"), "_finding")
    lines = files.join(asked.select(F.col("p").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("p"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    by_line = Window.partitionBy("p").orderBy("n")
    before = F.sum(F.octet_length("line") + 1).over(by_line) - F.octet_length("line") - 1
    starts = lines.select("p", before.alias("at"), F.lit(0).alias("what"), "line", F.lit(None).cast(asked.schema["_finding"].dataType).alias("_finding"), (F.col("n") + 1).alias("number"))
    order = Window.partitionBy("p").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(asked.withColumn("number", F.lit(None).cast("int")))
    here = F.max(F.when(F.col("what") == 0, F.struct("number", "at", "line"))).over(order)
    placed = both.withColumn("_l", here).where("what = 1")
    inside = F.expr("cast(substring(cast(_l.line as binary), 1, cast(at - _l.at as int)) as string)")
    found = placed.select("_finding.*", F.col("_l.number").alias("line"), (F.length(inside) + 1).alias("column"))
    none = F.lit(None).cast("int")
    return found.unionByName(findings.where("offset is null").withColumn("line", none).withColumn("column", none))


def sarif_rows(findings: DataFrame, uri_prefix: str = "", files: DataFrame | None = None) -> DataFrame:
    """part, ord, line: one SARIF result for each finding, with its region where files (path, text) tell it."""
    if files is not None:
        findings = located(findings, files)
    subject = F.coalesce("path", "src")
    uri = F.concat(F.lit(uri_prefix), F.replace(F.replace(F.url_encode(subject), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))
    region = [] if files is None else [F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))).alias("region")]
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), *region).alias("physicalLocation"))
    body = F.struct(F.col("rule").alias("ruleId"), F.lit("error").alias("level"), F.struct(message().alias("text")).alias("message"), F.array(place).alias("locations"))
    return _lines(findings, 0, F.concat_ws("\u0000", F.lpad(F.col("rule_ord").cast("string"), 6, "0"), subject), F.to_json(body))


def sarif_document(g: DependencyGraph, findings: DataFrame, uri_prefix: str = "", files: DataFrame | None = None) -> DataFrame:
    """part, ord, line: a SARIF log of one run: its rules, each once in order, and a result for each finding."""
    named = findings.select("rule").distinct()
    listed = _elements(_lines(named, 1, F.col("rule"), F.to_json(F.struct(F.col("rule").alias("id")))))
    results = _elements(sarif_rows(findings, uri_prefix, files).withColumn("part", F.lit(3)))
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"weftgraph","rules":['
    return reduce(DataFrame.unionByName, [_fixed(g, 0, head), listed, _fixed(g, 2, ']}},"results":['), results, _fixed(g, 4, "]}]}")])


def write(lines: DataFrame, path: str) -> None:
    """The lines as text files that follow one another in the order of their names."""
    lines.orderBy("part", "ord").select("line").write.text(path)
