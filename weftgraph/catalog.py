"""The registered queries over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, names, paths, recover
from .operators import dependencies, gradle, graph, iterate, manifests, resolve, rules
from .plans import reports
from .plans.scan import ScanOptions, invalid, references, scan, unsupported
from .sources import cases, corpora
from .sources import files as files_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


TREE = corpora.TREE_SQL
PAIRS = "pairs AS (SELECT DISTINCT src, dst FROM edges)"
REACH = f"""{TREE}, {PAIRS}, closed AS (SELECT src, dst FROM pairs UNION SELECT c.src, p.dst FROM closed c JOIN pairs p ON c.dst = p.src)"""
COMPONENTS = f"""{REACH}, comps AS (SELECT path, least(path, coalesce(min(b.dst), path)) AS component FROM nodes LEFT JOIN
    (SELECT c.src, c.dst FROM closed c JOIN closed d ON c.src = d.dst AND c.dst = d.src) b ON b.src = path GROUP BY path)"""


# graphs and roll-ups


@register(f"""WITH {TREE}, pairs AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)
    SELECT path, count(*) AS fan_in FROM (SELECT dst AS path FROM pairs) GROUP BY path HAVING count(*) > 1""")
def most_depended_upon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_coupling(corpora.tree_graph(spark, sf_dir)).where(F.col("fan_in") > 1).select("path", "fan_in")


@register(f"WITH {corpora.ORDERS_SQL} SELECT src, dst, kind, count FROM edges")
def edges_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.orders_graph(spark, sf_dir).edges


for _depth in (0, 1):

    @register(f"""WITH {corpora.ORDERS_SQL} SELECT {"'.'" if _depth == 0 else "split_part(src, '/', 1)"} AS src, {"'.'" if _depth == 0 else "split_part(dst, '/', 1)"} AS dst, kind, CAST(sum(count) AS BIGINT) AS count
        FROM edges GROUP BY 1, 2, 3""", f"aggregate_depth{_depth}")
    def aggregate_depth(spark: SparkSession, sf_dir: str, depth: int = _depth) -> DataFrame:
        return corpora.orders_graph(spark, sf_dir).aggregate(depth).edges


@register(f"""WITH {TREE}, p AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
    i AS (SELECT dst AS path, count(*) AS n FROM p GROUP BY 1), o AS (SELECT src AS path, count(*) AS n FROM p GROUP BY 1)
    SELECT path, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out,
        CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) = 0 THEN 0.0 ELSE CAST(coalesce(o.n, 0) AS DOUBLE) / (coalesce(i.n, 0) + coalesce(o.n, 0)) END AS instability
    FROM nodes LEFT JOIN i USING (path) LEFT JOIN o USING (path)""")
def coupling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_coupling(corpora.tree_graph(spark, sf_dir))


@register(f"""WITH {corpora.ORDERS_SQL}, p AS (SELECT DISTINCT src, dst, split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS b FROM edges),
    x AS (SELECT a AS path, 0 AS i, 1 AS o, 0 AS f FROM p WHERE a <> b UNION ALL SELECT b, 1, 0, 0 FROM p WHERE a <> b UNION ALL SELECT split_part(path, '/', 1), 0, 0, 1 FROM nodes)
    SELECT path, CAST(sum(f) AS BIGINT) AS files, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out,
        CASE WHEN sum(i) + sum(o) = 0 THEN 0.0 ELSE CAST(sum(o) AS DOUBLE) / (sum(i) + sum(o)) END AS instability FROM x GROUP BY path""")
def coupling_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directory_coupling(corpora.orders_graph(spark, sf_dir))


@register(f"WITH {TREE} SELECT DISTINCT src AS path FROM edges WHERE dst = 'g0/f5.ts'")
def direct_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.direct(corpora.tree_graph(spark, sf_dir), "g0/f5.ts", dependents=True)


# fix-points


@register(f"""WITH RECURSIVE {TREE}, {PAIRS}, r AS (SELECT dst AS path FROM pairs WHERE src = 'g11/f7.ts' UNION SELECT p.dst FROM r JOIN pairs p ON p.src = r.path)
    SELECT path FROM r""")
def reach_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.reach(corpora.tree_graph(spark, sf_dir), ["g11/f7.ts"])


@register(f"""WITH RECURSIVE {TREE}, {PAIRS}, r AS (SELECT path FROM nodes WHERE path IN ('g7/f2.ts', 'gone.ts') UNION SELECT p.src FROM r JOIN pairs p ON p.dst = r.path)
    SELECT path FROM r""")
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.affected(corpora.tree_graph(spark, sf_dir), ["g7/f2.ts", "gone.ts"])


@register(f"WITH RECURSIVE {REACH} SELECT src, dst FROM closed")
def reach_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.all_reached(corpora.tree_graph(spark, sf_dir).pairs())


@register(f"WITH RECURSIVE {COMPONENTS} SELECT path, component FROM comps")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.components(corpora.tree_graph(spark, sf_dir))


@register(f"""WITH RECURSIVE {COMPONENTS}, between AS (SELECT DISTINCT a.component AS a, b.component AS b FROM pairs JOIN comps a ON a.path = src JOIN comps b ON b.path = dst WHERE a.component <> b.component),
    deep AS (SELECT component, 0 AS depth FROM comps UNION SELECT b, depth + 1 FROM deep JOIN between ON a = component)
    SELECT path, max(depth) AS depth FROM comps JOIN deep USING (component) GROUP BY path""")
def layers_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.layers(corpora.tree_graph(spark, sf_dir))


@register("""WITH g AS (SELECT p_partkey // 10 AS g FROM part WHERE (p_partkey // 10) % 3 = 0 GROUP BY 1 HAVING count(*) = 10)
    SELECT 'g' || g || '/f0.ts' AS component, (SELECT string_agg('g' || g || '/f' || i || '.ts', ' ' ORDER BY i) FROM range(10) t(i)) AS members,
        'g' || g || '/f0.ts ' || (SELECT string_agg('g' || g || '/f' || (9 - i) || '.ts', ' ' ORDER BY i) FROM range(10) t(i)) AS walk FROM g""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.cycles(corpora.tree_graph(spark, sf_dir)).select("component", F.array_join("members", " ").alias("members"), F.array_join("walk", " ").alias("walk"))


@register("SELECT 'g6/f3.ts g6/f2.ts g6/f1.ts g6/f0.ts g2/f5.ts g2/f4.ts g2/f3.ts g2/f2.ts g2/f1.ts g2/f0.ts g0/f5.ts g0/f4.ts' AS chain")
def chain_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.chain(corpora.tree_graph(spark, sf_dir), "g6/f3.ts", "g0/f4.ts").select(F.array_join("chain", " ").alias("chain"))


# rules over edges

LAYERS = rules.OrderedLayers("layers", (("**/f[0-3].ts",), ("**/f[4-6].ts",), ("**/f[7-9].ts",)))
FORBIDDEN = rules.EdgeRule("no-dynamic", "**/f0.ts", "**/f9.ts", kind="dynamic")
ALLOWED = rules.Allow("no-dynamic", source="g0/**")


@register(f"""WITH {TREE}, l AS (SELECT src, dst, kind, CAST(regexp_extract(src, 'f([0-9])', 1) AS INT) AS a, CAST(regexp_extract(dst, 'f([0-9])', 1) AS INT) AS b FROM edges)
    SELECT src, dst, kind FROM l WHERE CASE WHEN b < 4 THEN 0 WHEN b < 7 THEN 1 ELSE 2 END > CASE WHEN a < 4 THEN 0 WHEN a < 7 THEN 1 ELSE 2 END""")
def ordered_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ordered(corpora.tree_graph(spark, sf_dir), LAYERS).select("src", "dst", "kind")


@register("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'g' || (k // 10) || '/f1.ts' AS src, 'g' || (k // 10) || '/f0.ts' AS dst, 'import' AS kind,
    'g' || (k // 10) || '/f1.ts g' || (k // 10) || '/f0.ts g' || ((k // 10 - 1) // 2) || '/f5.ts' AS chain
    FROM p WHERE k % 10 = 1 AND k > 10 AND k - 1 IN (SELECT k FROM p) AND ((k // 10 - 1) // 2) * 10 + 5 IN (SELECT k FROM p)
    UNION ALL SELECT 'g0/f1.ts', 'g0/f0.ts', 'import', 'g0/f1.ts g0/f0.ts g0/f9.ts g0/f8.ts' WHERE (SELECT count(*) FROM p WHERE k IN (0, 1, 8, 9)) = 4""")
def ordered_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.OrderedLayers("layers", (("**/f1.ts",), ("**/f[58].ts",)), transitive=True)
    return rules.ordered(corpora.tree_graph(spark, sf_dir), rule).select("src", "dst", "kind", F.array_join("chain", " ").alias("chain"))


@register(f"WITH {TREE} SELECT src, dst, kind FROM edges WHERE kind = 'dynamic' AND src LIKE '%/f0.ts' AND dst LIKE '%/f9.ts'")
def forbidden_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forbidden(corpora.tree_graph(spark, sf_dir), FORBIDDEN).select("src", "dst", "kind")


@register(f"WITH {TREE} SELECT src, dst, kind FROM edges WHERE kind = 'dynamic' AND src LIKE '%/f0.ts' AND dst LIKE '%/f9.ts' AND src NOT LIKE 'g0/%'")
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.forbidden(corpora.tree_graph(spark, sf_dir), FORBIDDEN, (ALLOWED,)).select("src", "dst", "kind")


@register(f"""WITH {TREE}, g AS (SELECT src FROM edges WHERE src LIKE '%/f3.ts')
    SELECT src, concat_ws(' ', src, replace(src, '/f3', '/f2'), replace(src, '/f3', '/f1')) AS chain FROM g""")
def forbidden_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.EdgeRule("far", "**/f3.ts", "**/f1.ts", transitive=True)
    return rules.forbidden(corpora.tree_graph(spark, sf_dir), rule).select("src", F.array_join("chain", " ").alias("chain"))


@register(f"WITH {TREE} SELECT src, dst, kind FROM edges WHERE dst LIKE '%/f5.ts'")
def nothing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.nothing_imports(corpora.tree_graph(spark, sf_dir), rules.NothingImports("entry", "**/f5.ts")).select("src", "dst", "kind")


@register("SELECT 'readme' AS rule, 'README.md' AS path")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.required(corpora.tree_graph(spark, sf_dir), (rules.Required("readme", "README.md"), rules.Required("root", "g0/f0.ts"))).select("rule", "path")


@register("""SELECT 'g' || g || '/f0.ts' AS src, 'g' || g || '/f9.ts' AS dst, 'dynamic' AS kind
    FROM (SELECT p_partkey // 10 AS g FROM part WHERE (p_partkey // 10) % 3 = 0 GROUP BY 1 HAVING count(*) = 10)""")
def no_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.no_cycles(corpora.tree_graph(spark, sf_dir), rules.NoCycles("acyclic")).select("src", "dst", "kind")


@register(f"""WITH RECURSIVE {TREE}, {PAIRS}, r AS (SELECT path FROM nodes WHERE path LIKE 'g1%/f9.ts' UNION SELECT p.dst FROM r JOIN pairs p ON p.src = r.path)
    SELECT path FROM nodes WHERE path NOT IN (SELECT path FROM r)""")
def reachable_unreached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reachable(corpora.tree_graph(spark, sf_dir), rules.Reachable("reached", "**", ("g1*/f9.ts",))).select("path")


# scans of source texts


def _scan(language: str):
    options = ScanOptions(kinds=({"markdown": "link", "assets": "asset"}[language],)) if language in ("markdown", "assets") else ScanOptions(languages=(language,))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(corpora.source_files(spark, sf_dir, language), options).edges

    return query


for _language in corpora.LANGUAGES:
    _sql = f"WITH {corpora.language_sql(_language)} SELECT src, dst, kind, CAST(count(*) AS BIGINT) AS count FROM edges GROUP BY ALL"
    if _language == "go":  # a package is all its files
        _sql = f"WITH {corpora.language_sql('go')} SELECT a.path AS src, b.path AS dst, kind, CAST(count(*) AS BIGINT) AS count FROM (SELECT DISTINCT k, t // 10 AS tg, t, kind FROM raw JOIN nodes USING (k) WHERE t IN (SELECT k FROM nodes)) r JOIN nodes a ON a.k = r.k JOIN nodes b ON b.g = r.tg GROUP BY ALL"
    register(_sql, f"scan_{_language}")(_scan(_language))


@register("""SELECT 'g' || (p_partkey // 10) || '/f' || (p_partkey % 10) || '.c' AS path, 's' AS name FROM part""")
def token_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recover.tokens(corpora.source_files(spark, sf_dir, "c"), "c")
    return rules.tokens(found, rules.TokenRule("owned", ("s",), owners=("x/**",))).select("path", "name")


@register("""SELECT page_id, CAST(len(list_filter(regexp_extract_all(coalesce(html, ''), '[0-9A-Za-z./_@\\-\\x{80}-\\x{10FFFF}]+'), lambda x: strlen(x) >= 3)) AS BIGINT) AS runs FROM pages""")
def asset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = recover.asset_paths(pages.select(F.col("page_id").alias("path"), F.col("html").alias("text")))
    counted = found.groupBy(F.col("src").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("runs"))


# manifests and dependencies

PACKAGES = "f AS (SELECT p_partkey AS k, p_partkey // 10 AS g FROM part), gs AS (SELECT DISTINCT g FROM f)"


@register(f"""WITH {PACKAGES} SELECT 'g' || g || '/package.json' AS manifest, 'p' || (g % 7) AS name, '^1.0.0' AS requirement, '' AS source, 'registry' AS origin, 'runtime' AS scope FROM gs
    UNION ALL SELECT 'g' || g || '/package.json', 'unused' || (g % 3), 'github:a/b', 'github:a/b', 'remote', 'runtime' FROM gs
    UNION ALL SELECT 'g' || g || '/package.json', 'tool', 'file:../tool', 'file:../tool', 'local', 'development' FROM gs""")
def manifest_package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifests.package_json(corpora.package_files(spark, sf_dir))
    return rows.select("manifest", "name", "requirement", "source", "origin", names.dependency_scope(F.col("manifest"), F.col("grp")).alias("scope"))


def _uses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = corpora.package_files(spark, sf_dir)
    declared = manifests.package_json(files)
    refs = recover.imports(files.where(F.endswith("path", F.lit(".ts"))), "javascript").select("src", "pos", "name", F.lit(False).alias("resolved"))
    return dependencies.used(refs, declared, "npm"), declared


@register(f"WITH {PACKAGES} SELECT 'g' || g || '/f' || (k % 10) || '.ts' AS src, 'p' || (k % 7) AS package FROM f WHERE k % 7 <> g % 7")
def deps_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.undeclared(_uses(spark, sf_dir)[0]).select("src", "package")


@register(f"""WITH {PACKAGES} SELECT 'g' || g || '/package.json' AS manifest, 'unused' || (g % 3) AS name FROM gs
    UNION ALL SELECT 'g' || g || '/package.json', 'p' || (g % 7) FROM gs WHERE g NOT IN (SELECT g FROM f WHERE k % 7 = g % 7)""")
def deps_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses, declared = _uses(spark, sf_dir)
    return dependencies.unused(uses, declared, "npm")


# the function library


@register("""SELECT p_partkey, 'b/' || p_partkey || '/c' AS normal, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'd' || p_partkey END AS escaped, 'b' AS first, 'b/' || p_partkey AS dir, 'c' AS base FROM part""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    normal = paths.normalize(F.concat(F.lit("a/../b//./"), k, F.lit("/x/../c")))
    escaped = paths.normalize(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/../../d"), k)).otherwise(F.concat(F.lit("a/../d"), k)))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", normal.alias("normal"), escaped.alias("escaped"))
    return rows.select("*", paths.directory("normal", 1).alias("first"), paths.dirname("normal").alias("dir"), paths.basename("normal").alias("base"))


@register(f"WITH {TREE} SELECT path, path LIKE 'g1/%' AS below, regexp_full_match(path, 'g[0-9]/f[0-4]\\.ts') AS spelled, regexp_full_match(path, '(.*/)?f[^/]\\.ts') AS anywhere FROM nodes")
def glob_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return corpora.tree_graph(spark, sf_dir).paths.select("path", globs.matches(p, "g1/**").alias("below"), globs.matches(p, "g[0-9]/f[0-4].ts").alias("spelled"), globs.matches(p, "f?.ts").alias("anywhere"))


_EXT = ["ts", "py", "go", "rs", "md", "svg", "bin"]


@register("""SELECT p_partkey, ['javascript', 'python', 'go', 'rust', NULL, NULL, NULL][p_partkey % 7 + 1] AS language,
    ['import test type_only dynamic', 'import test type_only dynamic', 'import test', 'import test', 'link asset', 'asset', ''][p_partkey % 7 + 1] AS kinds FROM part""")
def names_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, _EXT)), (F.col("p_partkey") % 7).cast("int"))
    p = F.concat(F.lit("a/b"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", names.language_of(p).alias("language"), F.array_join(names.kinds_of(p), " ").alias("kinds"))


# reports


def _findings(g: graph.DependencyGraph) -> DataFrame:
    return rules.check(g, rules.Rules(ordered=(LAYERS,), forbidden=(FORBIDDEN,), allowed=(ALLOWED,), required=(rules.Required("readme", "README.md"),)))


@register(f"""WITH {TREE} SELECT 0 AS part, '{{"path":"' || path || '"}}' AS line FROM nodes
    UNION ALL SELECT 1, '{{"src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '","count":1}}' FROM edges""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_rows(corpora.tree_graph(spark, sf_dir)).select("part", "line")


@register(f"""WITH {TREE}, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM nodes)
    SELECT 0 AS part, 'flowchart LR' AS line UNION ALL SELECT 2, '  n' || i || '["' || path || '"]' FROM n
    UNION ALL SELECT 3, '  n' || a.i || CASE kind WHEN 'dynamic' THEN ' -.->|dynamic| n' ELSE ' --> n' END || b.i FROM edges JOIN n a ON a.path = src JOIN n b ON b.path = dst""")
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mermaid(corpora.tree_graph(spark, sf_dir)).select("part", "line")


@register(f"""WITH {TREE}, bad AS (SELECT DISTINCT src, dst, kind FROM edges WHERE kind = 'dynamic' AND src LIKE '%/f0.ts' AND dst LIKE '%/f9.ts' AND src NOT LIKE 'g0/%')
    SELECT 0 AS part, 'digraph dependencies {{' || chr(10) || '  rankdir=LR;' AS line UNION ALL SELECT 3, '}}'
    UNION ALL SELECT 1, '  "' || path || '"' || CASE WHEN path IN (SELECT src FROM bad UNION SELECT dst FROM bad) THEN ' [color="#cc0000", fontcolor="#cc0000", penwidth=2]' ELSE '' END || ';' FROM nodes
    UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '"' || CASE WHEN kind <> 'dynamic' THEN '' WHEN src IN (SELECT src FROM bad) THEN ' [style=dotted, color="#cc0000", penwidth=2]' ELSE ' [style=dotted]' END || ';' FROM edges""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpora.tree_graph(spark, sf_dir)
    return reports.dot(g, rules.check(g, rules.Rules(forbidden=(FORBIDDEN,), allowed=(ALLOWED,)))).select("part", "line")


@register(f"""WITH {TREE} SELECT '{{"ruleId":"no-dynamic","level":"error","message":{{"text":"' || src || ' -> ' || dst || ' is forbidden"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"r/' || src || '"}}}}}}]}}' AS line
    FROM edges WHERE kind = 'dynamic' AND src LIKE '%/f0.ts' AND dst LIKE '%/f9.ts' AND src NOT LIKE 'g0/%'""")
def sarif_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpora.tree_graph(spark, sf_dir)
    return reports.sarif_rows(rules.check(g, rules.Rules(forbidden=(FORBIDDEN,), allowed=(ALLOWED,))), "r/").select("line")


@register(f"""WITH {TREE}, e AS (SELECT *, row_number() OVER (ORDER BY src, dst, kind) AS n FROM edges), p AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM nodes)
    SELECT 0 AS part, '{{"format":"weftgraph","version":1,"paths":[' AS line UNION ALL SELECT 2, '],"edges":[' UNION ALL SELECT 6, ']}}'
    UNION ALL SELECT 1, CASE WHEN n > 1 THEN ',' ELSE '' END || '"' || path || '"' FROM p
    UNION ALL SELECT 3, CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '","count":1}}' FROM e""")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_document(corpora.tree_graph(spark, sf_dir)).select("part", "line")


@register(f"""WITH {TREE}, bad AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS n FROM edges WHERE kind = 'dynamic' AND src LIKE '%/f0.ts' AND dst LIKE '%/f9.ts' AND src NOT LIKE 'g0/%')
    SELECT 0 AS part, '{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"weftgraph","rules":[' AS line UNION ALL SELECT 2, ']}}}},"results":[' UNION ALL SELECT 4, ']}}]}}'
    UNION ALL SELECT DISTINCT 1, '{{"id":"no-dynamic"}}' FROM bad
    UNION ALL SELECT 3, CASE WHEN n > 1 THEN ',' ELSE '' END || '{{"ruleId":"no-dynamic","level":"error","message":{{"text":"' || src || ' -> ' || dst || ' is forbidden"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || src || '"}}}}}}]}}' FROM bad""")
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpora.tree_graph(spark, sf_dir)
    return reports.sarif_document(g, rules.check(g, rules.Rules(forbidden=(FORBIDDEN,), allowed=(ALLOWED,)))).select("part", "line")


# constructed cases: what texts, manifests and patterns say


def _said(rows: list[tuple], many: int, names_: str, select: str) -> str:
    return f"SELECT p_partkey AS k, {select} FROM part JOIN {cases.values(rows, names_)} ON p_partkey % {many} = c"


def _key(column: str) -> str:
    return f"replace({column}, '§', CAST(p_partkey AS VARCHAR))"


def _imports_of(language: str):
    texts = cases.IMPORTS[language]
    rows = [(c, n, name, kind) for c, (_, found) in enumerate(texts) for n, (name, kind) in enumerate(found)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = cases.case_files(spark, sf_dir, [(f"a.{cases.EXTENSION[language]}", t) for t, _ in texts])
        found = recover.imports(files, language).withColumnRenamed("src", "path").join(files.select("path", "k").hint("merge"), "path")
        order = Window.partitionBy("k").orderBy("pos", "ord")
        return found.select("k", (F.row_number().over(order) - 1).alias("n"), "name", "kind")

    return _said(rows, len(texts), "c, n, name, kind", f"n, {_key('name')} AS name, kind"), query


for _language in cases.IMPORTS:
    _sql, _query = _imports_of(_language)
    register(_sql, f"imports_{_language}")(_query)

_UNSUPPORTED = [(c, e) for c, (_, _, found) in enumerate(cases.UNSUPPORTED) for e in found]


@register(_said(_UNSUPPORTED, len(cases.UNSUPPORTED), "c, expression", "expression"))
def unsupported_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [(f"a.{cases.EXTENSION[la]}", t) for la, t, _ in cases.UNSUPPORTED])
    return unsupported(files).join(files.select("path", "k"), "path").select("k", "expression")


@register("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT p_partkey AS k, {cases._sql(kind)} AS kind, {_key(cases._sql(text))} AS text, {offset} AS offset, {line} AS line, {column} AS \"column\" FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_partkey AS n FROM part) WHERE n % {len(cases.TOKENS)} = {c}".replace("SELECT p_partkey AS k", "SELECT n AS k")
    for c, (_, _, found) in enumerate(cases.TOKENS) for kind, text, offset, line, column in found) + ")")
def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for c, (la, text, _) in enumerate(cases.TOKENS):
        files = cases.case_files(spark, sf_dir, [("a", t) for _, t, _ in cases.TOKENS]).where(F.col("k") % len(cases.TOKENS) == c)
        parts.append(recover.tokens(files, la).where(F.startswith("text", F.lit("own"))))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k"), "kind", "text", "offset", "line", "column")


@register("SELECT p_partkey AS k, 'a' || p_partkey || ' ( b' AS text FROM part")
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [("a.ts", "x = a§(b, \"a ( b\"); // a ( b\n")])
    found = rules.tokens(recover.tokens(files, "javascript", sequences=3), rules.TokenRule("call", ("a* ( ?",), kind="sequence"))
    return found.select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k"), F.col("name").alias("text"))


@register(cases.tree_sql())
def resolve_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(cases.tree_files(spark, sf_dir)).edges


@register(_said([(c, e, h) for c, (e, h) in enumerate(cases.CONSTRAINTS)], len(cases.CONSTRAINTS), "c, expression, holds", "expression, holds"))
def go_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [("a.go", e) for e, _ in cases.CONSTRAINTS])
    return files.select("k", F.col("text").alias("expression"), resolve.holds(F.col("text"), ("linux", "amd64", "own", "unix")).alias("holds"))


@register(_said([(c, *d) for c, (_, _, found) in enumerate(cases.MANIFESTS) for d in found], len(cases.MANIFESTS), "c, name, requirement, source, grp, origin", f"{_key('name')} AS name, {_key('requirement')} AS requirement, {_key('source')} AS source, grp, origin"))
def manifest_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [(m, t) for m, t, _ in cases.MANIFESTS])
    found = manifests.declared(files)
    return found.select(F.regexp_extract("manifest", "^d([0-9]+)", 1).cast("long").alias("k"), "name", "requirement", "source", "grp", "origin")


_PATTERNS = [(n, p, v, w) for n, t in (("path", cases.GLOBS), ("name", cases.NAMES), ("word", cases.WORDS)) for p, v, w in t]


@register(f"SELECT p_partkey AS k, n, pattern, {_key('said')} AS said, hit FROM part, {cases.values(_PATTERNS, 'n, pattern, said, hit')}")
def pattern_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"path": globs.matches, "name": lambda c, p: globs.matches(c, p, anywhere=False), "word": globs.matches_token}
    each = [F.struct(F.lit(n).alias("n"), F.lit(p).alias("pattern"), cases.filled(F.lit(v)).alias("said"), how[n](cases.filled(F.lit(v)), p).alias("hit")) for n, p, v, _ in _PATTERNS]
    return cases.keys(spark, sf_dir).select("k", F.inline(F.array(*each)))


@register("""SELECT p_partkey AS k, 'a.ts' AS path, 'lib/x' || p_partkey || '.js' AS name FROM part""")
def reference_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [("a.ts", "import '../d§/lib/x§.js'; import './lib/y.css'; import '../d§/lib/ok.js'; import './z§.js';")])
    refs = references(files, ScanOptions(languages=("javascript",)))
    rule = rules.ReferenceRule("lib", "d*/lib/*", unresolved_only=True, relative=True, suffix=".js", except_targets=("d*/lib/ok.js",))
    found = rules.references(refs, rule)
    return found.select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k"), F.element_at(F.split("path", "/"), -1).alias("path"), F.regexp_extract("name", "(lib/.*)$", 1).alias("name"))


_PY = "import yaml, req§, os\nfrom Foo_Bar import x\nimport mine§\n"


@register("""SELECT p_partkey AS k, reason, replace(name, '§', CAST(p_partkey AS VARCHAR)) AS name FROM part, (VALUES ('undeclared', 'mine§'), ('unused', 'spare§')) v(reason, name)""")
def check_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.case_files(spark, sf_dir, [("m/a.py", _PY)]).select("path", "text")
    project = '[project]\ndependencies = [\n  "pyyaml",\n  "req§>1",\n  "foo-bar",\n  "spare§",\n  "quiet",\n]\n'
    files = files.unionByName(cases.case_files(spark, sf_dir, [("pyproject.toml", project)]).select("path", "text"))
    refs = references(files, ScanOptions(languages=("python",)))
    rule = rules.DependencyRule("declared", "python", ignore=("quiet",), aliases=(("yaml", "pyyaml"),))
    g = graph.DependencyGraph.from_edges(files.select("path"), corpora.tree_graph(spark, sf_dir).edges.limit(0))
    found = rules.check(g, rules.Rules(dependencies=(rule,)), refs=refs, declared=manifests.declared(files))
    return found.select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k"), "reason", "name")


@register("""SELECT p_partkey AS k, ['development', 'build', 'optional', 'runtime', 'development'][p_partkey % 5 + 1] AS scope,
    ['', '', 'v' || p_partkey, '', 'main'][p_partkey % 5 + 1] AS revision, ['b', 'a', 'c', 'n' || p_partkey, 'd'][p_partkey % 5 + 1] AS short FROM part""")
def declaration_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = [("pom.xml", "test", "g:b", "", ""), ("build.gradle", "compileOnly", "g:a", "", ""), ("pyproject.toml", "project.optional-dependencies.x", "c", "", "git+https://h/c@v§"), ("go.mod", "require", "e.org/n§/v2", "v2.0.0", "e.org/n§/v2"), ("package.json", "devDependencies", "@s/d", "git://h/d#main", "git://h/d#main")]
    case = spark.createDataFrame([(n, *map(str, r)) for n, r in enumerate(table)], "c int, manifest string, grp string, name string, requirement string, source string")
    rows = cases.keys(spark, sf_dir).withColumn("c", (F.col("k") % len(table)).cast("int")).join(F.broadcast(case), "c")
    at = {c: cases.filled(F.col(c)) for c in ("manifest", "grp", "name", "requirement", "source")}
    return rows.select("k", names.dependency_scope(at["manifest"], at["grp"]).alias("scope"), names.dependency_revision(at["manifest"], at["source"], at["requirement"]).alias("revision"), names.dependency_short_name(at["manifest"], at["name"]).alias("short"))


@register("""SELECT p_partkey AS k, p_partkey % 2 = 0 AS within, p_partkey % 3 = 0 AS test FROM part""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    under = F.when(k % 2 == 0, F.concat(F.lit("a/b"), k.cast("string"), F.lit("/c"))).otherwise(F.concat(F.lit("a/b"), k.cast("string"), F.lit("x/c")))
    file = F.when(k % 3 == 0, F.get(F.array(*map(F.lit, ("x_test.go", "test_x.py", "tests/tx.nim", "a/__tests__/b.ts", "a.spec.ts", "src/test/java/A.java"))), (k / 3 % 6).cast("int"))).otherwise(F.lit("src/main/java/ATest.java"))
    return cases.keys(spark, sf_dir).select("k", paths.within(F.concat(F.lit("a/b"), k.cast("string")), under).alias("within"), names.test_file(file).alias("test"))


@register("""SELECT p_partkey AS k, p_partkey % 4 = 0 AS unread FROM part""")
def unread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases.keys(spark, sf_dir).select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.when(F.col("k") % 4 != 0, "x").alias("text"))
    gone = files_.unread(rows.unionByName(rows)).withColumn("unread", F.lit(True))
    return rows.join(gone, "path", "left").select("k", F.coalesce("unread", F.lit(False)).alias("unread"))


# composed texts: as many pieces, in such an order and nested as deep as a key of `part` says

_GRADLE_SAID = [(c, *d) for c, (_, found) in enumerate(cases.GRADLE) for d in found]
_GRADLE_ROWS = cases.composed_sql(_GRADLE_SAID, len(cases.GRADLE), "grp, name, requirement, origin")


def _gradle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/build.gradle"))
    return cases.composed_files(spark, sf_dir, name, [t for t, _ in cases.GRADLE], "plugins { id 'no' }\ndependencies {\n", "}\nno.dependencies { api 'no:dot:1' }\ntask { from \"\"\"api 'no:text:1'\"\"\" }\n", ('${ "x" + g("', '") }'))


@register(f"SELECT k, grp, {cases.said_sql('name')} AS name, {cases.said_sql('requirement')} AS requirement, origin FROM {_GRADLE_ROWS} WHERE grp IS NOT NULL")
def gradle_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.gradle(_gradle_files(spark, sf_dir))
    return found.select(F.regexp_extract("manifest", "^d([0-9]+)", 1).cast("long").alias("k"), "grp", "name", "requirement", "origin")


@register(f"SELECT k, count(*) AS computed FROM {_GRADLE_ROWS} WHERE grp IS NULL GROUP BY k")
def gradle_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gradle.unsupported(_gradle_files(spark, sf_dir))
    return found.groupBy(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("computed"))


# packages of platforms: names that no manifest declares, whatever their place in a text

_OUTSIDE = [("java", "javax.crypto.spec.Key§", None), ("java", "org.w3c.dom.Node¤", None), ("java", "javax.inject.Scope§", "javax.inject"), ("java", "com.google.common.collect.Maps¤", "com.google.common.collect"), ("java", "jdk.jfr.Event", None), ("java", "org.w3c.dome§.X", "org.w3c.dome§"), ("nim", "tables", None), ("nim", "pkg/tables", "tables"), ("nim", "chronicles§/x", "chronicles§"), ("nim", "std/net§", None), ("nim", "nett", "nett"), ("npm", "node:fs§", None), ("npm", "@s§/p/x", "@s§/p"), ("npm", "fs/promises", None), ("python", "os.path", None), ("python", "yaml§.x", "yaml§"), ("cargo", "core::mem", None), ("cargo", "::serde§::de", "serde§")]


@register(f"SELECT k, i, {cases.said_sql('package')} AS package FROM {cases.composed_sql([(c, p) for c, (_, _, p) in enumerate(_OUTSIDE)], len(_OUTSIDE), 'package')}")
def packages_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases.composed_rows(spark, sf_dir, [f"{e} {n}" for e, n, _ in _OUTSIDE])
    name, kind = F.substring_index("said", " ", -1), F.substring_index("said", " ", 1)
    package = F.coalesce(*(F.when(kind == e, names.package_of(e, name)) for e in dict.fromkeys(e for e, _, _ in _OUTSIDE)))
    return rows.select("k", "i", package.alias("package"))


_LINKS = [(c, n) for c, (_, found) in enumerate(cases.MARKDOWN) for n in found]


@register(f"SELECT k, {cases.said_sql('name')} AS name FROM {cases.composed_sql(_LINKS, len(cases.MARKDOWN), 'name')}")
def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/a.md"))
    files = cases.composed_files(spark, sf_dir, name, [t for t, _ in cases.MARKDOWN], nest=("x [", "] y"))
    return recover.markdown_links(files).select(F.regexp_extract("src", "^d([0-9]+)", 1).cast("long").alias("k"), "name")


_PLACED = [(c, n, *(f or (None, None, None))) for c, (_, n, f) in enumerate(cases.PLACED)]
_PLACED_SQL = f"SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) - n + line AS row FROM {cases.composed_sql(_PLACED, len(cases.PLACED), 'n, line, col, name')}"


@register(f"""SELECT '{{"ruleId":"no-bad","level":"error","message":{{"text":"d' || k || '/a.ts names ' || {cases.said_sql('name')} || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"d' || k
    || '/a.ts"}},"region":{{"startLine":' || row || ',"startColumn":' || col || '}}}}}}]}}' AS line FROM ({_PLACED_SQL}) WHERE name IS NOT NULL""")
def sarif_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cases.composed_files(spark, sf_dir, F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/a.ts")), [t for t, _, _ in cases.PLACED]).select("path", "text")
    refs = recover.imports(files, "javascript").select("src", "pos", "name", F.lit(None).cast("string").alias("member"), "kind", F.lit(False).alias("resolved"))
    return reports.sarif_rows(rules.references(refs, rules.ReferenceRule("no-bad", "./bad*")), files=files).select("line")


# four layers and a forbidden way, walked together: within a group f9 leads to f8, and so on to f0


@register("""WITH f AS (SELECT p_partkey // 10 AS g FROM part GROUP BY 1 HAVING count(*) = 10), w(rule, a, b) AS (VALUES ('layers', 9, 6), ('layers', 6, 3), ('layers', 3, 0), ('far', 3, 1))
    SELECT rule, 'g' || g || '/f' || a || '.ts' AS src, 'g' || g || '/f' || (a - 1) || '.ts' AS dst, 'import' AS kind, (SELECT string_agg('g' || g || '/f' || (a - i) || '.ts', ' ' ORDER BY i) FROM range(10) r(i) WHERE i <= a - b) AS chain
    FROM f, w WHERE rule <> 'far' OR g > 0""")
def shared_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    layered = rules.OrderedLayers("layers", (("**/f9.ts",), ("**/f6.ts",), ("**/f3.ts",), ("**/f0.ts",)), transitive=True)
    far = rules.EdgeRule("far", "**/f3.ts", "**/f1.ts", kind="import", transitive=True)
    found = rules.check(corpora.tree_graph(spark, sf_dir), rules.Rules(ordered=(layered,), forbidden=(far,), allowed=(rules.Allow("far", source="g0/**"),)))
    return found.select("rule", "src", "dst", "kind", F.array_join("chain", " ").alias("chain"))


@register(f"""WITH RECURSIVE {TREE}, r AS (SELECT dst AS path FROM edges WHERE src = 'g11/f7.ts' AND kind = 'import' UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.path WHERE e.kind = 'import' AND r.path NOT LIKE 'g2/%')
    SELECT path FROM r""")
def reach_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.reach(corpora.tree_graph(spark, sf_dir), ["g11/f7.ts"], follow=F.col("kind") == "import", passable=~globs.matches(F.col("path"), "g2/**"))


# boxes within boxes: groups of several digits lie as deep as they have digits


def _deep_graph(spark: SparkSession, sf_dir: str) -> graph.DependencyGraph:
    g = corpora.tree_graph(spark, sf_dir)
    deep = lambda c: F.regexp_replace(F.regexp_replace(c, "^g([0-9])([0-9]+)/", "g$1/h$2/"), "/h([0-9])([0-9]+)/", "/h$1/i$2/").alias(c)
    return graph.DependencyGraph(g.paths.select(deep("path")), g.edges.select(deep("src"), deep("dst"), "kind", "count"))


_DEEP = f"""{TREE}, d AS (SELECT path AS flat, regexp_replace(regexp_replace(path, '^g([0-9])([0-9]+)/', 'g\\1/h\\2/'), '/h([0-9])([0-9]+)/', '/h\\1/i\\2/') AS p FROM nodes),
    e AS (SELECT a.p AS src, b.p AS dst, kind FROM edges JOIN d a ON a.flat = src JOIN d b ON b.flat = dst),
    bad AS (SELECT src, dst FROM e WHERE kind = 'dynamic' AND src NOT LIKE 'g0/%'), named AS (SELECT src AS p FROM bad UNION SELECT dst FROM bad),
    dirs AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:n], '/') AS dir, CAST(n AS INT) AS n FROM d, range(1, 4) r(n) WHERE n < len(string_split(p, '/')))"""
_DEEP_FINDINGS = rules.EdgeRule("no-dynamic", "**/f0.ts", "**/f9.ts", kind="dynamic")


def _ordered_lines(lines: DataFrame) -> DataFrame:
    return reports.positions(lines.withColumn("_o", F.concat_ws("\u0000", "part", "ord")), "_o").select(F.col("position").alias("n"), "line")


@register(f"""WITH {_DEEP}, lines AS (
    SELECT 0 AS part, '' AS ord, 'digraph dependencies {{{{' || chr(10) || '  rankdir=LR;' AS line UNION ALL SELECT 3, '', '}}}}'
    UNION ALL SELECT 1, dir || '/', repeat('  ', n) || 'subgraph "cluster_' || dir || '" {{{{' || chr(10) || repeat('  ', n) || '  label="' || split_part(dir, '/', n) || '";' FROM dirs
    UNION ALL SELECT 1, dir || '/' || chr(1114111), repeat('  ', n) || '}}}}' FROM dirs
    UNION ALL SELECT 1, p, repeat('  ', len(string_split(p, '/'))) || '"' || p || '" [label="' || string_split(p, '/')[-1] || '"' || CASE WHEN p IN (SELECT p FROM named) THEN ', color="#cc0000", fontcolor="#cc0000", penwidth=2' ELSE '' END || '];' FROM d
    UNION ALL SELECT 2, src || chr(1) || dst || chr(1) || kind, '  "' || src || '" -> "' || dst || '"' || CASE WHEN kind <> 'dynamic' THEN '' WHEN src IN (SELECT src FROM bad) THEN ' [style=dotted, color="#cc0000", penwidth=2]' ELSE ' [style=dotted]' END || ';' FROM e)
    SELECT row_number() OVER (ORDER BY part, ord) - 1 AS n, line FROM lines""".replace("{{", "{").replace("}}", "}"))
def report_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _deep_graph(spark, sf_dir)
    return _ordered_lines(reports.dot(g, rules.check(g, rules.Rules(forbidden=(_DEEP_FINDINGS,), allowed=(ALLOWED,))), cluster="directory"))


@register(f"""WITH {_DEEP}, c AS (SELECT p, CASE WHEN regexp_matches(p, 'f[0-3]\\.ts$') THEN 0 WHEN regexp_matches(p, 'f[7-9]\\.ts$') THEN 1 ELSE 2 END AS l, row_number() OVER (ORDER BY p) - 1 AS i FROM d),
    x AS (SELECT src, dst, kind, row_number() OVER (ORDER BY src, dst) - 1 AS i FROM e), used AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i FROM c WHERE l < 2 GROUP BY l), lines AS (
    SELECT 0 AS part, '' AS ord, 'flowchart LR' AS line UNION ALL SELECT DISTINCT 1, '', '  classDef finding stroke:#cc0000,stroke-width:2px,color:#cc0000' FROM named
    UNION ALL SELECT 2, l || '', '  subgraph d' || i || '["' || ['low', 'high'][l + 1] || '"]' FROM used UNION ALL SELECT 2, l || '/' || chr(1114111), '  end' FROM used
    UNION ALL SELECT 2, l || '/' || p, CASE l WHEN 2 THEN '  n' ELSE '    n' END || i || '["' || p || '"]' || CASE WHEN p IN (SELECT p FROM named) THEN ':::finding' ELSE '' END FROM c
    UNION ALL SELECT 3, src || chr(1) || dst, '  n' || a.i || CASE kind WHEN 'dynamic' THEN ' -.->|dynamic| n' ELSE ' --> n' END || b.i FROM e JOIN c a ON a.p = src JOIN c b ON b.p = dst
    UNION ALL SELECT 4, lpad(CAST(i AS VARCHAR), 19, '0'), '  linkStyle ' || i || ' stroke:#cc0000,stroke-width:2px' FROM x WHERE kind = 'dynamic' AND src NOT LIKE 'g0/%')
    SELECT row_number() OVER (ORDER BY part, ord) - 1 AS n, line FROM lines""")
def report_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _deep_graph(spark, sf_dir)
    found = rules.check(g, rules.Rules(forbidden=(_DEEP_FINDINGS,), allowed=(ALLOWED,)))
    return _ordered_lines(reports.mermaid(g, found, cluster="layer", layers=(("low", ("**/f[0-3].ts",)), ("high", ("**/f[7-9].ts",)))))


# workspaces of several modules: groups of keys whose modules replace one dependency alike, differently, or overruled


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text. Of the group g, g % 4 + 2 modules are in a workspace; the first requires a module and imports it, the
    last replaces it too: by the same directory (g % 3 = 0), by another (1), or by another that the workspace overrules (2)."""
    groups, g = cases.groups(spark, sf_dir), F.col("k").cast("string")
    last = (F.col("k") % 4 + 1).cast("string")
    other = F.when(F.col("k") % 3 == 0, "one").otherwise("two")
    over = F.when(F.col("k") % 3 == 2, "replace e.org/dep v1.0.0 => ./two\n").otherwise("")
    uses = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("k") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("  ./m"), i.cast("string"), F.lit("\n"))), "")
    file = lambda name, *text: F.struct(F.concat(F.lit("w"), g, F.lit("/"), *name).alias("path"), F.concat(*text).alias("text"))
    lit = F.lit
    return groups.select(F.inline(F.array(
        file([lit("go.work")], lit("go 1.22\nuse (\n"), uses, lit(")\n"), over),
        file([lit("m0/go.mod")], lit("module e.org/m0\nrequire e.org/dep v1.0.0\nreplace e.org/dep => ../one\n")),
        file([lit("m0/a.go")], lit("package a\n// é\nimport \"e.org/dep/pkg\"\n")),
        file([lit("m"), last, lit("/go.mod")], lit("module e.org/m"), last, lit("\nreplace e.org/dep v1.0.0 => ../"), other, lit("\n")),
        *(file([lit(f"{d}/go.mod")], lit("module e.org/dep\n")) for d in ("one", "two")),
        *(file([lit(f"{d}/pkg/p.go")], lit("package pkg\n")) for d in ("one", "two")),
    )))


_WORKSPACES = "w AS (SELECT DISTINCT p_partkey // 10 AS g FROM part)"


@register(f"WITH {_WORKSPACES} SELECT 'w' || g || '/m0/a.go' AS src, 'w' || g || CASE g % 3 WHEN 0 THEN '/one/pkg/p.go' ELSE '/two/pkg/p.go' END AS dst, 'import' AS kind FROM w WHERE g % 3 <> 1")
def go_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_workspaces(spark, sf_dir), ScanOptions(languages=("go",))).edges.select("src", "dst", "kind")


@register(f"WITH {_WORKSPACES} SELECT 'w' || g || '/m0/a.go' AS path, 'ConflictingReplacement' AS cause, CAST(16 AS BIGINT) AS offset FROM w WHERE g % 3 = 1")
def go_replacement_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid(_workspaces(spark, sf_dir), ScanOptions(languages=("go",)))


# manifests that break off: the first statement that is none, in bytes

_TOML = [(c, t, at) for c, (t, at) in enumerate(cases.TOML)]
_TOML_TEXT = "replace(replace(text, '«', repeat('[', CAST((k + i) % 3 AS INT))), '»', repeat(']', CAST((k + i) % 3 AS INT)))"


@register(f"""WITH p AS (SELECT k, i, broken, {cases.said_sql(_TOML_TEXT)} AS said FROM {cases.composed_sql(_TOML, len(cases.TOML), 'text, broken')}),
    f AS (SELECT k, min(i) AS i FROM p WHERE broken IS NOT NULL GROUP BY k),
    before AS (SELECT p.k, sum(CASE WHEN p.i < f.i THEN strlen(said) WHEN broken = 1 THEN strlen(split_part(said, chr(10), 1)) + 1 ELSE 0 END) AS n FROM p JOIN f ON p.k = f.k AND p.i <= f.i GROUP BY p.k)
    SELECT k, CAST(n AS BIGINT) AS offset FROM before""")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/Cargo.toml"))
    files = cases.composed_files(spark, sf_dir, name, [t for t, _ in cases.TOML], nest=("[", "]"), deepest=3)
    return manifests.invalid(files.select("path", "text")).select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("k"), "offset")
