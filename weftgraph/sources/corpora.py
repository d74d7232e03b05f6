"""Graphs and files derived from the shared tables by construction, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import DependencyGraph
from .shared import spread


def tree_sql(ext: str = "ts", f: str = "f", top: str = "", plain: str = "import", dynamic: str = "dynamic") -> str:
    return f"""nodes AS (SELECT p_partkey AS k, p_partkey // 10 AS g, '{top}g' || (p_partkey // 10) || '/{f}' || (p_partkey % 10) || '.{ext}' AS path FROM part),
    raw AS (SELECT k, k - 1 AS t, '{plain}' AS kind FROM nodes WHERE k % 10 > 0
        UNION ALL SELECT k, ((k // 10 - 1) // 2) * 10 + 5, '{plain}' FROM nodes WHERE k % 10 = 0 AND k >= 10
        UNION ALL SELECT k, k + 9, '{dynamic}' FROM nodes WHERE k % 30 = 0),
    edges AS (SELECT a.path AS src, b.path AS dst, kind, 1 AS count FROM raw JOIN nodes a ON raw.k = a.k JOIN nodes b ON raw.t = b.k)"""


TREE_SQL = tree_sql()

ORDERS_SQL = """edges AS (SELECT 'n' || c_nationkey || '/c' || c_custkey AS src, 'n' || s_nationkey || '/s' || s_suppkey AS dst,
        CASE l_returnflag WHEN 'A' THEN 'dynamic' WHEN 'R' THEN 'type_only' ELSE 'import' END AS kind, CAST(count(*) AS BIGINT) AS count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    nodes AS (SELECT 'n' || c_nationkey || '/c' || c_custkey AS path FROM customer UNION SELECT 'n' || s_nationkey || '/s' || s_suppkey FROM supplier)"""


def _group(k: Column) -> Column:
    return F.floor(k / 10).cast("string")


def _place(k: Column) -> Column:
    return (k % 10).cast("string")


def tree_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """k of every file, and k, t, kind of every reference whose target is there.

    Files are in groups of ten: each imports the one before it, the first of a group imports a file of the parent
    group, and in every third group a dynamic import closes a cycle."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")), "k")
    k = F.col("k")
    parent = F.floor((F.floor(k / 10) - 1) / 2) * 10 + 5
    targets = F.array(
        F.when(k % 10 > 0, F.struct((k - 1).alias("t"), F.lit("import").alias("kind"))),
        F.when((k % 10 == 0) & (k >= 10), F.struct(parent.alias("t"), F.lit("import").alias("kind"))),
        F.when(k % 30 == 0, F.struct((k + 9).alias("t"), F.lit("dynamic").alias("kind"))),
    )
    raw = part.select("k", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("e")).select("k", F.col("e.t").alias("t"), F.col("e.kind").alias("kind"))
    return part, raw.join(part.select(F.col("k").alias("t")).hint("merge"), "t", "left_semi")


def tree_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    part, raw = tree_rows(spark, sf_dir)
    name = lambda k: F.concat(F.lit("g"), _group(k), F.lit("/f"), _place(k), F.lit(".ts"))
    edges = raw.select(name(F.col("k")).alias("src"), name(F.col("t")).alias("dst"), "kind", F.lit(1).cast("long").alias("count"))
    return DependencyGraph.from_edges(part.select(name(F.col("k")).alias("path")), edges)


def orders_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    """Customers in the directory of their nation depend upon suppliers in that of theirs, once a line item."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string")).alias("src"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string")).alias("dst"))
    kind = F.when(F.col("l_returnflag") == "A", "dynamic").when(F.col("l_returnflag") == "R", "type_only").otherwise("import")
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", kind.alias("kind"))
    joined = lines.join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    edges = joined.select("src", "dst", "kind", F.lit(1).cast("long").alias("count"))
    return DependencyGraph.from_edges(c.select(F.col("src").alias("path")).unionByName(s.select(F.col("dst").alias("path"))), edges)


# Of each language the folder on top, the letter and the extension of its files, a line that names
# another file (in three pieces), the same for a dynamic import, and lines that look like references and are none.
LANGUAGES: dict[str, tuple] = {
    "c": ("", "f", "c", ('#include "../g', "/f", '.c"\n'), None, '// #include "../g0/f0.c"\n/*\n#include "../g0/f0.c"\n*/\nchar *s = "#include";\n'),
    "javascript": ("", "f", "ts", ('import x from "../g', "/f", '";\n'), ('const y = import("../g', "/f", '");\n'), "// import \"../g0/f0\"\nconst s = \"import '../g0/f0'\";\n"),
    "python": ("", "f", "py", ("import g", ".f", " as m\n"), None, '"""\nimport g0.f0\n"""\n# import g0.f0\ns = "import g0.f0"\n'),
    "rust": ("src/", "f", "rs", ("use crate::g", "::f", "::Item;\n"), None, "// use crate::g0::f0;\n/*\nuse crate::g0::f0;\n*/\n"),
    "nim": ("", "f", "nim", ("import ../g", "/f", "\n"), None, "# import ../g0/f0\n#[\nimport ../g0/f0\n]#\n"),
    "java": ("", "F", "java", ("import g", ".F", ";\n"), None, '// import g0.F0;\nclass A { String s = "import g0.F0;"; }\n'),
    "zig": ("", "f", "zig", ('const a = @import("../g', "/f", '.zig");\n'), None, '// @import("../g0/f0.zig")\n'),
    "markdown": ("", "f", "md", ("[x](../g", "/f", ".md)\n"), None, "```\n[x](../g0/f0.md)\n```\n<!-- [x](../g0/f0.md) -->\n`[x](../g0/f0.md)`\n"),
    "assets": ("", "f", "txt", ("see g", "/f", ".txt now\n"), None, "ab g0 f0\n"),
    "go": ("", "f", "go", ('import "example.org/m/g', "", '"\n'), None, '// import "example.org/m/g0"\n'),
}


def language_sql(language: str) -> str:
    top, letter, ext, _, dynamic, _ = LANGUAGES[language]
    plain = {"markdown": "link", "assets": "asset"}.get(language, "import")
    return tree_sql(ext, letter, top, plain, "dynamic" if dynamic else plain)


def source_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """path and text of the tree's files in a language."""
    top, letter, ext, plain, dynamic, decoys = LANGUAGES[language]
    part, raw = tree_rows(spark, sf_dir)
    t = F.col("t")

    def line(pieces: tuple[str, str, str]) -> Column:
        return F.concat(F.lit(pieces[0]), _group(t), *([F.lit(pieces[1]), _place(t)] if pieces[1] else []), F.lit(pieces[2]))

    said = raw.select("k", (F.when(F.col("kind") == "dynamic", line(dynamic)).otherwise(line(plain)) if dynamic else line(plain)).alias("line"))
    lines = said.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("lines"))  # two lines at most
    head = F.concat(F.lit("package g"), _group(F.col("k")), F.lit(";\n")) if language == "java" else F.lit("")
    path = F.concat(F.lit(f"{top}g"), _group(F.col("k")), F.lit(f"/{letter}"), _place(F.col("k")), F.lit(f".{ext}"))
    files = part.join(lines.hint("merge"), "k", "left").select(path.alias("path"), F.concat(head, F.lit(decoys), F.coalesce("lines", F.lit(""))).alias("text"))
    if language == "go":
        files = files.unionByName(spark.createDataFrame([("go.mod", "module example.org/m\n\ngo 1.22\n")], "path string, text string"))
    return spread(files, "path")  # texts are put together once, however many steps read them


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package.json for each group, and files that import packages of seven."""
    part, _ = tree_rows(spark, sf_dir)
    k = F.col("k")
    g = F.floor(k / 10)
    files = part.select(F.concat(F.lit("g"), _group(k), F.lit("/f"), _place(k), F.lit(".ts")).alias("path"), F.concat(F.lit('import q from "p'), (k % 7).cast("string"), F.lit('/sub";\nimport fs from "fs";\n')).alias("text"))
    manifests = part.select(g.alias("g")).distinct().select(
        F.concat(F.lit("g"), F.col("g").cast("string"), F.lit("/package.json")).alias("path"),
        F.concat(F.lit('{"dependencies": {"p'), (F.col("g") % 7).cast("string"), F.lit('": "^1.0.0", "unused'), (F.col("g") % 3).cast("string"), F.lit('": "github:a/b"}, "devDependencies": {"tool": "file:../tool"}}')).alias("text"),
    )
    return files.unionByName(manifests)
