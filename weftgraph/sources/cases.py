"""Small texts and what they hold, by construction, in Spark and in SQL alike: § stands for the key of a row of `part`.

Fixed values: the cases. They say what the languages' own rules say of such texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, spread

#: Per language: texts with the (name, kind) of their references, in order.
IMPORTS: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {
    "c": [
        ('/* a note:\n#include "note.h"\n*/ #  include "far/a§.h"\n#include <b§> /* with */ // more\n', [("far/a§.h", "import"), ("b§", "import")]),
        ('auto s = u8R"tag("\n#include "fake.h"\n)tag";\n#include \\\n "r§.h"\nx #include "no.h"\n', [("r§.h", "import")]),
        ("#error it's\n#include \"q§.h\"\n", [("q§.h", "import")]),
    ],
    "javascript": [
        ("const r = /\"/; import './a§';\nexport * from './b§';", [("./a§", "import"), ("./b§", "import")]),
        ("const t = `import('no') ${import('./c§')}`; if (x) /require('no')/.test(y);", [("./c§", "dynamic")]),
        ("import type { T } from './d§'; import { type U } from './e§'; let v: typeof import('./f§');", [("./d§", "type_only"), ("./e§", "type_only"), ("./f§", "type_only")]),
        ("require('./\\x67§'); a.require('no'); // import 'no'\n", [("./g§", "import")]),
    ],
    "python": [
        ("import a§; import b§ as c\nfrom . import d§\n", [("a§", "import"), ("b§", "import"), (".", "import"), (".d§", "import")]),
        ("'''\nimport no\n'''\nfrom p§ import (x as y, # no\n  z)\n", [("p§", "import"), ("p§.x", "import"), ("p§.z", "import")]),
        ("if TYPE_CHECKING:\n    import t§\nimport u§\n", [("t§", "type_only"), ("u§", "import")]),
        ("importlib.import_module('.m§', 'q.r')\n__import__('n§')\n", [("q.r.m§", "dynamic"), ("n§", "dynamic")]),
    ],
    "go": [
        ('package a\nimport (\n // "no" )\n x "e.org/a§"\n _ `e.org/b§`\n)\n', [("e.org/a§", "import"), ("e.org/b§", "import")]),
        ("package a\nvar s = `import \"no\"`\nimport . \"e.org/c§\"\n", [("e.org/c§", "import")]),
    ],
    "rust": [
        ("/* mod no; /* mod no; */ mod no; */\nmod a§;\nuse crate::{b::{c§, d::{e, self}}, f as g};", [("a§", "import"), ("crate::b::c§", "import"), ("crate::b::d::e", "import"), ("crate::b::d", "import"), ("crate::f", "import")]),
        ('let s = br##""x" mod no;"##; #[cfg(test)]\nmod tests { use super::h§; }\n', [("super::h§", "test")]),
    ],
    "nim": [
        ("#[ import no #[ x ]# ]#\nimport std/[os, a§], ../b§ as c\n", [("std/os", "import"), ("std/a§", "import"), ("../b§", "import")]),
        ('when x: import d§\nfrom e§/f import g\ninclude "h§"\n', [("d§", "import"), ("e§/f", "import"), ("h§", "import")]),
    ],
    "java": [
        ("package p;\nimport a.B§;\nimport static c.D§.e;\nimport f.g§.*;\nclass X { String t = \"\"\"\nimport no;\n\"\"\"; }", [("a.B§", "import"), ("c.D§.e", "import"), ("f.g§.*", "import")]),
    ],
    "zig": [
        ('// @import("no.zig")\nconst a = @import("a§.zig"); const s =\n    \\\\@import("no.zig")\n;', [("a§.zig", "import")]),
        ('const b = @import("b\\x2d§.zig");', [("b-§.zig", "import")]),
    ],
}

EXTENSION = {"c": "c", "javascript": "ts", "python": "py", "go": "go", "rust": "rs", "nim": "nim", "java": "java", "zig": "zig"}

#: (language, text, expressions) of constructs whose target is not written out.
UNSUPPORTED = [
    ("c", "#include M§\n", ["c_include"]),
    ("javascript", "import(a§); require(b);", ["javascript_import", "javascript_require"]),
    ("python", "importlib.import_module(a§)\n__import__(b)\n", ["python_importlib", "python_import"]),
    ("rust", '#[path = "§.rs"] mod a; include!("b.rs");', ["rust_path", "rust_include"]),
    ("nim", "import $§\n", ["nim_import"]),
    ("java", "class A { Object a = Class.forName(n§); Object b = l.loadClass(n); }", ["java_for_name", "java_load_class"]),
    ("zig", "const a = @import(n§);", ["zig_import"]),
]

#: (language, text, (kind, text, offset, line, column) of identifiers and strings that begin with own or `a .`).
TOKENS = [
    ("javascript", "// own§\nlet own§ = 'own\\x2d§';\n", [("identifier", "own§", "11 + length(p_partkey)", 2, "5"), ("string", "own-§", "17 + 2 * length(p_partkey)", 2, "11 + length(p_partkey)")]),
    ("c", 'char *own§ = "own\\055§"; /* own */ int n = 0xFF;', [("identifier", "own§", "6", 1, "7"), ("string", "own-§", "12 + length(p_partkey)", 1, "13 + length(p_partkey)")]),
    ("zig", 'const @"own§" = 1;', [("identifier", "own§", "6", 1, "7")]),
    ("python", "x = r'own\\n§'\n", [("string", "own\\n§", "5", 1, "6")]),
]

#: Files below a folder of each group, and the edges between them.
TREES: list[tuple[dict[str, str], list[tuple[str, str, str, int]]]] = [
    # aliases of the nearest config, inherited; the longest part before a star wins, then the base
    (
        {"ts/tsconfig.json": '{ // base\n "extends": "./cfg/base", "compilerOptions": { "paths": { "@/*": ["src/*"], "@/lib/*": ["lib/*", "src/lib/*"], "one": ["src/one.ts"], }, } }', "ts/cfg/base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"no": ["no.ts"]}}}',
         "ts/src/a.ts": "import '@/b'; import '@/lib/c'; import 'one'; import 'src/b'; import './b.js'; import './d.mjs';", "ts/src/b.ts": "", "ts/src/lib/c.ts": "", "ts/src/one.ts": "", "ts/src/d.d.mts": "", "ts/src/d.mts.ts": ""},
        [("ts/src/a.ts", "ts/src/b.ts", "import", 3), ("ts/src/a.ts", "ts/src/lib/c.ts", "import", 1), ("ts/src/a.ts", "ts/src/one.ts", "import", 1), ("ts/src/a.ts", "ts/src/d.d.mts", "import", 1)],
    ),
    # a workspace's module, a replaced one, a nested one that is none of its parent's, test files
    (
        {"go/go.work": "go 1.22\nuse (\n ./m\n ./n\n)\n", "go/m/go.mod": "module e.org/m\nrequire e.org/r v1.0.0\nreplace e.org/r => ../r\n", "go/n/go.mod": "module e.org/n\n", "go/r/go.mod": "module e.org/r\n", "go/m/deep/go.mod": "module e.org/deep\n",
         "go/m/a.go": 'package m\nimport (\n "e.org/n/x"\n "e.org/r"\n "e.org/m/deep"\n)\n', "go/n/x/x.go": "package x\n", "go/n/x/x_test.go": "package x\n", "go/n/x/_skip.go": "package x\n", "go/r/r.go": "package r\n", "go/m/deep/d.go": "package deep\n"},
        [("go/m/a.go", "go/n/x/x.go", "import", 1), ("go/m/a.go", "go/n/x/x_test.go", "test", 1), ("go/m/a.go", "go/r/r.go", "import", 1)],
    ),
    # search paths of configs, the nearer and later first; pkg/ is never beside
    (
        {"nim/nim.cfg": '--path:"lib"\n', "nim/app/config.nims": 'switch("path", "own")\n', "nim/lib/a.nim": "", "nim/app/own/a.nim": "", "nim/lib/b.nim": "", "nim/app/b.nim": "", "nim/app/m.nim": "import a, pkg/b\n"},
        [("nim/app/m.nim", "nim/app/own/a.nim", "import", 1), ("nim/app/m.nim", "nim/lib/b.nim", "import", 1)],
    ),
    # modules, inline modules, declared ones, tests and what they declare
    (
        {"rs/src/lib.rs": "mod a;\n#[cfg(test)]\nmod t;\nuse a::b::C;\nmod inner { mod d; }\n", "rs/src/a.rs": "pub mod b;\nuse super::inner::d::E;\n", "rs/src/a/b.rs": "use crate::a::F;\n", "rs/src/t.rs": "mod u;\nuse crate::a;\n", "rs/src/t/u.rs": "", "rs/src/inner/d.rs": ""},
        [("rs/src/lib.rs", "rs/src/a.rs", "import", 1), ("rs/src/lib.rs", "rs/src/t.rs", "test", 1), ("rs/src/lib.rs", "rs/src/a/b.rs", "import", 1), ("rs/src/lib.rs", "rs/src/inner/d.rs", "import", 1), ("rs/src/a.rs", "rs/src/a/b.rs", "import", 1), ("rs/src/a.rs", "rs/src/inner/d.rs", "import", 1),
         ("rs/src/a/b.rs", "rs/src/a.rs", "import", 1), ("rs/src/t.rs", "rs/src/t/u.rs", "test", 1), ("rs/src/t.rs", "rs/src/a.rs", "test", 1)],
    ),
    # types by their declared package wherever they lie; stars; nested types; test sources
    (
        {"jv/src/main/App.java": "package app; import §lib.Util; import §lib.Util.In.Deep; import §lib.*; import static §lib.Util.*; import other.No;", "jv/x/Util.java": "package §lib; class Util {}", "jv/y/Help.java": "package §lib; class Help {}", "jv/src/test/T.java": "package app; import §lib.Util;", "jv/x/package-info.java": "package §lib;"},
        [("jv/src/main/App.java", "jv/x/Util.java", "import", 4), ("jv/src/main/App.java", "jv/y/Help.java", "import", 1), ("jv/src/test/T.java", "jv/x/Util.java", "test", 1)],
    ),
    # relative names, the packages between, and what a star brings along
    (
        {"py/pkg/__init__.py": "from .impl import thing\n__all__ = ['thing']\n", "py/pkg/impl.py": "", "py/pkg/sub/__init__.py": "", "py/pkg/sub/m.py": "from .. import *\nfrom ..impl import thing\nfrom . import n\n", "py/pkg/sub/n.py": "", "py/pkg/sub/test_n.py": "from .n import q\n"},
        [("py/pkg/__init__.py", "py/pkg/impl.py", "import", 1), ("py/pkg/sub/m.py", "py/pkg/__init__.py", "import", 1), ("py/pkg/sub/m.py", "py/pkg/impl.py", "import", 2), ("py/pkg/sub/m.py", "py/pkg/sub/__init__.py", "import", 1), ("py/pkg/sub/m.py", "py/pkg/sub/n.py", "import", 1), ("py/pkg/sub/test_n.py", "py/pkg/sub/n.py", "test", 1)],
    ),
]

#: (constraint, whether it holds for linux, amd64 and the tag own; null: malformed).
CONSTRAINTS = [("linux && amd64", True), ("!linux", False), ("darwin || (unix && !cgo)", True), ("own && !(windows || darwin)", True), ("linux && arm64 || own", True), ("!(own || linux) || amd64 && darwin", False), ("linux &&", None), ("(linux", None), ("!!own", True)]

#: (manifest, text, (name, requirement, source, group, origin) of each declaration).
MANIFESTS: list[tuple[str, str, list[tuple[str, str, str, str, str]]]] = [
    ("package.json", '{"dependencies": {"a§": "^1.0", "w": "workspace:*"}, "optionalDependencies": {"g": "git+https://h/x.git"}}', [("a§", "^1.0", "", "dependencies", "registry"), ("w", "workspace:*", "workspace:*", "dependencies", "workspace"), ("g", "git+https://h/x.git", "git+https://h/x.git", "optionalDependencies", "remote")]),
    ("go.mod", "module e.org/m\n\nrequire (\n\te.org/a§ v1.2.3\n\te.org/b v0.1.0 // indirect\n)\nrequire e.org/c v2.0.0\n", [("e.org/a§", "v1.2.3", "e.org/a§", "require", "remote"), ("e.org/b", "v0.1.0", "e.org/b", "indirect", "remote"), ("e.org/c", "v2.0.0", "e.org/c", "require", "remote")]),
    ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\na§ = "1"\nb = { version = "2", path = "../b" }\n[dev-dependencies.c]\nversion = "3"\ngit = "https://h/c"\n[[bin]]\nname = "n"\n', [("a§", "1", "", "dependencies", "registry"), ("b", "2", "../b", "dependencies", "local"), ("c", "3", "https://h/c", "dev-dependencies", "remote")]),
    ("pyproject.toml", '[project]\ndependencies = [\n  "a§>=1",\n  "b @ https://h/b.zip",\n]\n[project.optional-dependencies]\nx = ["c~=2"]\n[tool.poetry.dependencies]\npython = "^3.12"\nd = "^4"\n', [("a§", ">=1", "", "project.dependencies", "registry"), ("b", "", "https://h/b.zip", "project.dependencies", "remote"), ("c", "~=2", "", "project.optional-dependencies.x", "registry"), ("d", "^4", "", "tool.poetry.dependencies", "registry")]),
    ("pom.xml", "<project><properties><v>1.§</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>2</version><scope>test</scope><optional>true</optional></dependency></dependencies></project>", [("g:a", "1.§", "", "compile", "registry"), ("h:b", "2", "", "test,optional", "registry")]),
    ("build.gradle", "dependencies {\n  implementation 'g:a:1.§'\n  testImplementation(\"h:b:2\")\n  // api 'no:no:1'\n}\n", [("g:a", "1.§", "", "implementation", "registry"), ("h:b", "2", "", "testImplementation", "registry")]),
    ("x.nimble", 'requires "nim >= 2.0"\nrequires "a§ >= 1.0", "https://h/b"\ntaskRequires "t", "c"\n', [("a§", ">= 1.0", "", "requires", "registry"), ("https://h/b", "", "https://h/b", "requires", "remote"), ("c", "", "", "taskRequires.t", "registry")]),
    ("build.zig.zon", '.{ .name = .x, .dependencies = .{ .a = .{ .url = "https://h/§", .hash = "q" }, .b = .{ .path = "../b" } } }', [("a", "q", "https://h/§", "dependencies", "remote"), ("b", "", "../b", "dependencies", "local")]),
]

#: (pattern, path, whether it matches): of paths, of names and of tokens.
GLOBS = [("*.ts", "a/b§.ts", True), ("a/*.ts", "a/b/§.ts", False), ("a/**", "a/§", True), ("a/**", "a", False), ("**/t/*.py", "t/§.py", True), ("**/t/*.py", "x/y/t/§.py", True), ("a/[!b]*", "a/c§", True), ("a/[!b]*", "a/b§", False), ("a\\*b", "a*b", True), ("**", "", True)]
NAMES = [("look*", "look§", True), ("look*", "vendor/look§", False), ("a/**/b", "a/x§/y/b", True), ("@s/*", "@s/p§", True)]
WORDS = [("ki*", "kill§", True), ("k?ll", "kill", True), ("k?ll", "kiill", False), ("*/x*", "a/b/x§", True), ("a[b]", "a[b]", True)]


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({names})"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")), "k")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select(F.floor(F.col("k") / 10).alias("k")).distinct()


def filled(c: Column) -> Column:
    return F.replace(c, F.lit("§"), F.col("k").cast("string"))


def case_files(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str]]) -> DataFrame:
    """k, path and text: each key has the case that its remainder says, as (name of the file, text)."""
    table = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(cases)], "c int, name string, text string")
    rows = keys(spark, sf_dir).withColumn("c", (F.col("k") % len(cases)).cast("int")).join(F.broadcast(table), "c")
    # read by several steps, so put together once
    return settle(rows.select("k", F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/"), "name").alias("path"), filled(F.col("text")).alias("text")), "files")


#: How many pieces a composed text has at most.
MOST_PIECES = 9


def composed_files(spark: SparkSession, sf_dir: str, name: Column, pieces: list[str], head: str = "", tail: str = "", nest: tuple[str, str] = ("", ""), deepest: int = 8) -> DataFrame:
    """k, path and text: a text of each key of `part`, put together from as many pieces, in such an order, as the key says.

    In a piece § stands for the key, ¤ for its place, « and » for the two strings of nest, as often as key and place say."""
    k, table = F.col("k"), F.array(*map(F.lit, pieces))
    count = (k % MOST_PIECES).cast("int")

    def piece(i: Column) -> Column:
        raw = F.get(table, ((k * 31 + i * 17 + i * i) % len(pieces)).cast("int"))
        deep = ((k + i) % deepest).cast("int")
        placed = F.replace(F.replace(raw, F.lit("§"), k.cast("string")), F.lit("¤"), i.cast("string"))
        return F.replace(F.replace(placed, F.lit("«"), F.repeat(F.lit(nest[0]), deep)), F.lit("»"), F.repeat(F.lit(nest[1]), deep))

    text = F.concat(F.lit(head), F.array_join(F.transform(F.sequence(F.lit(0), count), piece), ""), F.lit(tail))
    return keys(spark, sf_dir).select("k", name.alias("path"), text.alias("text"))


def composed_rows(spark: SparkSession, sf_dir: str, pieces: list[str]) -> DataFrame:
    """k, i and said: the pieces of composed_files() one by one."""
    rows = keys(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % MOST_PIECES)).alias("i"))
    raw = F.get(F.array(*map(F.lit, pieces)), ((F.col("k") * 31 + F.col("i") * 17 + F.col("i") * F.col("i")) % len(pieces)).cast("int"))
    return rows.select("k", "i", F.replace(F.replace(raw, F.lit("§"), F.col("k").cast("string")), F.lit("¤"), F.col("i").cast("string")).alias("said"))


def composed_sql(rows: list[tuple], pieces: int, names: str) -> str:
    """A table expression: k, i and the columns of rows, whose first one c is a piece's number, for each piece of each text."""
    return f"""(SELECT * FROM (SELECT p_partkey AS k, i, (p_partkey * 31 + i * 17 + i * i) % {pieces} AS piece FROM part, range({MOST_PIECES}) r(i) WHERE i <= p_partkey % {MOST_PIECES}) JOIN {values(rows, 'c, ' + names)} ON c = piece)"""


def said_sql(column: str) -> str:
    return f"replace(replace({column}, '§', CAST(k AS VARCHAR)), '¤', CAST(i AS VARCHAR))"


#: Statements of Gradle's dependencies blocks, with (group, name, requirement, origin) of what each declares; a group of null: computed.
GRADLE: list[tuple[str, list[tuple[str | None, str, str, str]]]] = [
    ("  api 'a§.b:c¤:1.§'\n", [("api", "a§.b:c¤", "1.§", "registry")]),
    ('  api("d§:e¤:2:tests") {\n    exclude group: "x", module: "${ "y" }"\n  }\n', [("api", "d§:e¤", "2:tests", "registry")]),
    ("  runtimeOnly 'f:g§', \"h:i¤:3@zip\",\n    'j:k:¤'\n", [("runtimeOnly", "f:g§", "", "registry"), ("runtimeOnly", "h:i¤", "3@zip", "registry"), ("runtimeOnly", "j:k", "¤", "registry")]),
    ("  testApi group: 'l§', name: 'm', version: '¤', changing: true\n", [("testApi", "l§:m", "¤", "registry")]),
    ("  api project(path: ':n§'); api platform(\n  'o:p:¤'\n  )\n", [("api", ":n§", "", "workspace"), ("api", "o:p", "¤", "registry")]),
    ('  add("ksp", \'q:r§:¤\')\n', [("ksp", "q:r§", "¤", "registry")]),
    ("  constraints { api 'no:constraint§:1' }\n  // api 'no:line:1'\n  /* api 'no:block:1' */\n", []),
    ('  api "s:t§:${ f("«it»") }"\n', [(None, "", "", "")]),
    ("  api libs.u§\n", [(None, "", "", "")]),
    ("  if (v§) {\n    api 'no:if:1'\n  }\n", [(None, "", "", "")]),
    ("  api files('w§'), \"x:y:${z}\"\n", [(None, "", "", "")]),
]

#: Blocks of Markdown, with what their links name; « and » are brackets in the text of a link.
MARKDOWN: list[tuple[str, list[str]]] = [
    ("[l¤]: a§/¤.md\n\nSee [L¤].\n\n", ["a§/¤.md"]),
    ("[l¤]:\n  <b §.md>\n  'a\n  title'\n\n[«t»][l¤] and [l¤][]\n\n", ["b §.md", "b §.md"]),
    ("text\n[l¤]: no.md\n\n[l¤]\n\n", []),
    ("```\n[l¤]: no.md\n```\n[l¤] `[x](no.md)`\n\n", []),
    ("    [l¤]: no.md\n\n[l¤]\n\n", []),
    ("[l¤]: c§.md junk\n\n[l¤]: d¤.md\n[l¤]: no.md\n\n[l¤]\n\n", ["d¤.md", "d¤.md"]),
    ("# head\n[Straße ¤]: e§.md\n\n[STRASSE\n¤]\n\n", ["e§.md"]),
    ("[l¤]: http://h/§\n\n[l¤] [[w§|x]] [y](f¤.md#z) <!-- [l¤] -->\n\n", ["w§", "f¤.md"]),
    ("[o [l¤]][m¤] [in [l¤]](g.md)\n\n[l¤]: h§.md\n[m¤]: i¤.md\n\n", ["i¤.md", "h§.md", "g.md"]),
    ("\\[l¤] [l¤\\] [l¤]\n\n[l¤]: j§(¤).md\n\n", ["j§(¤).md"]),
    ("[l¤]: %41§%2x.md \"t\"\n\n![l¤]\n\n", ["A§%2x.md"]),
]
#: Statements of TOML, and the line of each that is no statement.
TOML: list[tuple[str, int | None]] = [
    ("# note § é\n[a.\"b c\".'d']\n\n", None),
    ('k§_¤ = "v\\"ä" # why\n', None),
    ("n¤ = [ 1_000, # one\n  «2.5», { x = 'y', z.w = true }, ]\n", None),
    ('t¤ = """a "quoted" \\"""\nline"""\nd¤ = 1979-05-27 07:32:00Z\n', None),
    ("[[points]]\r\nq¤ = '''it''s\n'''\n", None),
    ("e¤ = 'c:\\dir'\nf¤ = [\n]\n", None),
    ("g¤ = { a = 1,\n", 0),
    ('# é§\nh¤ = "open\n', 1),
    ("i¤ = 1 2\n", 0),
]
#: Statements of JavaScript among letters of several bytes: lines they take, and (line among them, column in characters, name) of a finding.
PLACED: list[tuple[str, int, tuple[int, int, str] | None]] = [
    ("/* é漢😀 */ import './bad§';\n", 1, (1, 11, "./bad§")),
    ("// x ß\n\n", 2, None),
    ("const t = `ü\nö`;\r\nimport './bad¤'\n", 3, (3, 1, "./bad¤")),
    ("let s = 'ä'; let q = require('./bad§¤');\n", 1, (1, 22, "./bad§¤")),
    ("import './good';\n", 1, None),
]


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of the files of TREES, once for each group of ten keys."""
    each = F.array(*(F.struct(F.lit(p).alias("name"), F.lit(t).alias("text")) for files, _ in TREES for p, t in files.items()))
    rows = groups(spark, sf_dir).select("k", F.inline(each))
    return rows.select(F.concat(F.lit("g"), F.col("k").cast("string"), F.lit("/"), "name").alias("path"), filled(F.replace("text", F.lit("§lib"), F.lit("l§"))).alias("text"))


def tree_sql() -> str:
    edges = [e for _, edges in TREES for e in edges]
    return f"SELECT 'g' || g || '/' || src AS src, 'g' || g || '/' || dst AS dst, kind, CAST(n AS BIGINT) AS count FROM (SELECT DISTINCT p_partkey // 10 AS g FROM part), {values(edges, 'src, dst, kind, n')}"
