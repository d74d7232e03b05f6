"""What texts hold. Each language's rules are taken one at a time: a text states the rule, and what it must give."""

import pytest
from pyspark.sql import functions as F
from weftgraph.functions import recover

#: rule: (text, names), by language.
RULES = {
    "c": {
        "blanks around the hash": ("  #\tinclude \"io/pipe.h\"\n", ["io/pipe.h"]),
        "angle brackets": ("#include <vector>\n#include<map>\n", ["vector", "map"]),
        "a line that goes on": ("#inc\\\nlude \"lost.h\"\n#include \\\n  <cstdio>\n", ["cstdio"]),
        "only at the start of a line": ("int z; #include \"late.h\"\n", []),
        "behind a comment that ends on the line": ("/* licence\n   of 1999 */#include \"after.h\"\n", ["after.h"]),
        "never inside a comment": ("/*\n#include \"old.h\"\n*/\n// #include \"older.h\"\n", []),
        "never inside a raw string": ("auto q = R\"~(\n#include \"sql.h\"\n)~\";\n#include \"db.h\"\n", ["db.h"]),
        "nor in a string that goes on": ("char m[] = \"say \\\n#include <no>\";\n", []),
        "an open quote ends with its line": ("#pragma don't\n#include \"next.h\"\n", ["next.h"]),
        "computed": ("#include CONFIG_FILE\n", []),
    },
    "javascript": {
        "side effects": ("import \"./setup\";", ["./setup"]),
        "defaults and names": ("import $, { map as each,\n filter } from './collections';", ["./collections"]),
        "exports from": ("export { area } from './shapes'; export * as all from \"./all\";", ["./shapes", "./all"]),
        "an export of its own": ("export const from = 'x', to = 'y'; export default class {}", []),
        "calls": ("const { join } = require('path'); let lazy = () => import(\"./page.jsx\");", ["path", "./page.jsx"]),
        "blanks in calls": ("require (\n  // here\n  './spaced'\n)", ["./spaced"]),
        "calls of something else": ("loader.require('./no'); this.import('./no'); required('./no')", []),
        "computed": ("import(base + '/x'); require(name)", []),
        "options": ("import('./data.json', { with: { type: 'json' } })", ["./data.json"]),
        "strings, comments, templates": ("'import \"./s\"'; // import './l'\n/* require('./b') */ `import('./t')`", []),
        "code in templates": ("const page = `<b>${ render(require('./row')) }</b>`", ["./row"]),
        "regular expressions": ("const quotes = /[\"'`]/g; import './real'", ["./real"]),
        "divisions": ("let half = whole / 2; import './a'; let part = x / y / z;", ["./a"]),
        "escapes": ("import './caf\\u00e9'; import './\\x2e\\u{1F40D}';", ["./café", "./.🐍"]),
    },
    "python": {
        "modules": ("import json, os.path as p\n", ["json", "os.path"]),
        "members": ("from collections import deque, OrderedDict as Od\n", ["collections", "collections.deque", "collections.OrderedDict"]),
        "dots": ("from . import near\nfrom ...far.away import thing\n", [".", ".near", "...far.away", "...far.away.thing"]),
        "brackets over lines": ("from shop import (  # goods\n    basket,\n    till,  # and money\n)\n", ["shop", "shop.basket", "shop.till"]),
        "stars": ("from everything import *\n", ["everything"]),
        "lines that go on": ("from a import b, \\\n    c\n", ["a", "a.b", "a.c"]),
        "statements behind semicolons": ("x = 1; import late\n", ["late"]),
        "long strings": ("\"\"\"Usage:\n    import nothing\n\"\"\"\nimport something\n", ["something"]),
        "quotes of the other kind": ("s = 'say \"import no\"'\n# import never\n", []),
        "an open quote ends with its line": ("t = 'left open\nimport still\n", ["still"]),
        "words that end alike": ("reimport = important = yield_from = 3\nraise Lost from cause\n", []),
        "loaders": ("m = importlib.import_module('plug.in')\nn = __import__(\"other\")\n", ["plug.in", "other"]),
        "loaders with a package": ("importlib.import_module('..base', 'pkg.sub.mod')\n", ["pkg.sub.base"]),
        "computed loaders": ("importlib.import_module(f'{x}')\n__import__(name)\n", []),
    },
    "go": {
        "one": ("package p\n\nimport \"net/http\"\n", ["net/http"]),
        "named": ("package p\nimport (\n\tlog \"example.net/log\"\n\t. `example.net/dot`\n\t_ \"example.net/init\"\n)\n", ["example.net/log", "example.net/dot", "example.net/init"]),
        "comments in a block": ("package p\nimport (\n\t// \"example.net/no\" )\n\t/* ) */ \"example.net/yes\" // why\n)\n", ["example.net/yes"]),
        "strings": ("package p\nconst usage = `\nimport \"none\"\n`\nvar s = \"import \\\"none\\\"\"\n", []),
    },
    "rust": {
        "modules": ("mod parse;\npub(super) mod print;\n", ["parse", "print"]),
        "a module in braces": ("mod inside { pub fn f() {} }\n", []),
        "paths": ("use crate::store::Disk;\nuse super::Error as E;\nuse self::inner::*;\n", ["crate::store::Disk", "super::Error", "self::inner"]),
        "trees": ("use crate::{net::{self, udp::Port}, time};\n", ["crate::net", "crate::net::udp::Port", "crate::time"]),
        "comments in comments": ("/* mod a; /* mod b; */ mod c; */\nmod d;\n", ["d"]),
        "raw strings": ("const T: &str = r#\"mod \"quoted\";\"#;\nmod e;\n", ["e"]),
        "strings over lines": ("let s = \"one\nmod f;\ntwo\";\n", []),
        "lifetimes are no quotes": ("fn g<'x>(y: &'x u8) -> char { '\\'' }\nmod h;\n", ["h"]),
        "words before colons are crates": ("fn i() { rand::random(); std::mem::drop(1); rand::rng(); }\n", ["rand"]),
        "but for what the file declares": ("mod tools;\nfn j() { tools::run() }\n", ["tools"]),
    },
    "nim": {
        "lists": ("import tables, sets as s, ../up\n", ["tables", "sets", "../up"]),
        "groups over lines": ("import std/[json,\n  times]\n", ["std/json", "std/times"]),
        "members": ("from strutils import join, split\n", ["strutils"]),
        "exceptions": ("import macros except error\n", ["macros"]),
        "included": ("include \"parts/one\", parts/two\n", ["parts/one", "parts/two"]),
        "behind a colon": ("when defined(js): import dom\n", ["dom"]),
        "comments in comments": ("#[ import a #[ import b ]# import c ]#\nimport d\n", ["d"]),
        "strings": ("let p = r\"a\\\"\nlet q = \"import no\"\nlet t = \"\"\"\nimport no\"\"\"\n", []),
        "pragmas": ("import fast {.all.}\nproc import2() {.importc: \"import\".}\n", ["fast"]),
    },
    "java": {
        "types": ("package a.b;\nimport c.D;\n", ["c.D"]),
        "members": ("import static c.D.e;\nimport static c.F.*;\n", ["c.D.e", "c.F.*"]),
        "blanks and comments": ("import g . /* here */ H ;", ["g.H"]),
        "text blocks": ("class I { String j = \"\"\"\n import k.L;\n \\\"\"\" import m.N;\n\"\"\"; }", []),
        "names": ("class O { void p() { q.import(); } }", []),
    },
    "zig": {
        "plain": ("const list = @import(\"list.zig\");", ["list.zig"]),
        "over lines": ("pub const m = @import(\n    \"map.zig\",\n);", ["map.zig"]),
        "escapes": ("const o = @import(\"\\x6fdd.zig\");", ["odd.zig"]),
        "comments, strings, lines of text": ("// @import(\"a.zig\")\nconst s = \"@import(\\\"b.zig\\\")\";\nconst t =\n    \\\\@import(\"c.zig\")\n;", []),
        "computed": ("const x = @import(name ++ \".zig\");", []),
    },
}


@pytest.mark.parametrize("language", list(RULES))
def test_imports(spark, language):
    files = spark.createDataFrame([(rule, text) for rule, (text, _) in RULES[language].items()], "path string, text string")
    got = {}
    for r in recover.imports(files, language).orderBy("src", "pos", "ord").collect():
        got.setdefault(r["src"], []).append(r["name"])
    assert got == {rule: names for rule, (_, names) in RULES[language].items() if names}


def test_offsets_are_bytes(spark):
    text = "'''ünïcode 🐍'''\nimport one\nif typing.TYPE_CHECKING:\n    from two import three\n    import four\nimport five\n"
    rows = recover.imports(spark.createDataFrame([("x", text)], "path string, text string"), "python").collect()
    raw = text.encode()
    starts = {"one": b"import one", "two": b"from two", "two.three": b"from two", "four": b"import four", "five": b"import five"}
    assert {r["name"]: r["kind"] for r in rows} == {n: "import" if n in ("one", "five") else "type_only" for n in starts}
    for r in rows:
        assert raw[r["pos"] :].startswith(starts[r["name"]])


#: Kinds, and the statements that have them.
KINDS = {
    ("javascript", "type_only"): ["import type Row from './m'", "import type { Row } from './m'", "export type * from './m'", "import { type Row, type Cell as C } from './m'", "type M = typeof import('./m')", "let r: import('./m').Row", "import type M = require('./m')"],
    ("javascript", "import"): ["import type from './m'", "import { type Row, cell } from './m'", "import { type as kind } from './m'", "require('./m')", "import './m'", "import type, { cell } from './m'"],
    ("javascript", "dynamic"): ["import('./m')", "import('./m').catch(stop)", "await import('./m')"],
    ("rust", "test"): ["#[cfg(test)]\nmod m;", "mod tests { use super::m; }", "#[cfg(test)]\nmod checks { mod deep { use crate::m; } }"],
    ("rust", "import"): ["#[cfg(not(test))]\nmod m;", "mod checks { use crate::m; }", "#[cfg(feature = \"m\")]\nuse crate::m;"],
    ("python", "dynamic"): ["importlib.import_module('m')", "__import__('m')"],
    ("python", "import"): ["import m", "if CHECKING:\n    import m\n"],
}


def test_kinds(spark):
    for (language, kind), texts in KINDS.items():
        files = spark.createDataFrame([(t, t) for t in texts], "path string, text string")
        assert {(r["src"], r["kind"]) for r in recover.imports(files, language).collect()} == {(t, kind) for t in texts}


def test_unsupported(spark):
    said = {
        "c": ("#include HERE\n#include \"there.h\"\n", ["c_include"]),
        "javascript": ("require(`./${x}`); import('./m'); import(/* chunk */ y)", ["javascript_require", "javascript_import"]),
        "python": ("__import__(a)\nimportlib.import_module(b)\n", ["python_import", "python_importlib"]),
        "rust": ("include!(concat!(\"a\", \"b\")); #[path = \"p.rs\"] mod q;", ["rust_include", "rust_path"]),
        "nim": ("include `a`\nimport (b)\nimport c\n", ["nim_include", "nim_import"]),
        "java": ("class A { Object b = c.loadClass(d), e = Class . forName(f); }", ["java_load_class", "java_for_name"]),
        "zig": ("const a = @import(b); const c = @import(\"d.zig\");", ["zig_import"]),
        "go": ("package a\nimport \"b\"\n", []),
    }
    for language, (text, want) in said.items():
        rows = recover.unsupported(spark.createDataFrame([("a", text)], "path string, text string"), language).orderBy("offset").collect()
        assert [r["expression"] for r in rows] == want, text


def test_zig_members(spark):
    text = 'const shapes = @import("shapes.zig");\nconst area = shapes . circle;\nconst side = @import("lines.zig").edge;\n// shapes.square\nconst s = "shapes.cube";\nconst t = box.shapes.cone;\n'
    rows = recover.zig_members(spark.createDataFrame([("a", text)], "path string, text string")).collect()
    assert sorted((r["name"], r["member"]) for r in rows) == [("lines.zig", "edge"), ("shapes.zig", "circle")]


#: Of each language a comment, character and raw text that hold no tokens, around {}.
AROUND = {
    "zig": ("// hue \"hue\"\n", "const c = 'h';\nconst l =\n    \\\\hue\n;\n"),
    "c": ("/* hue \"hue\" */", "char c = 'h';\nauto r = R\"(hue)\";\n"),
    "javascript": ("/* hue */ // 'hue'\n", "let r = /hue/;\nlet t = `hue`;\n"),
    "python": ("# hue 'hue'\n", "'''hue'''\n"),
    "go": ("/* hue */ // \"hue\"\n", "var c = 'h'\n"),
    "rust": ("/* hue /* \"hue\" */ */", "let c = 'h'; let r = r##\"hue\"##;\n"),
    "nim": ("#[ hue ]# # \"hue\"\n", "let c = 'h'\nlet t = \"\"\"hue\"\"\"\n"),
    "java": ("/** hue */ // \"hue\"\n", "char c = 'h'; String t = \"\"\"\nhue\n\"\"\";\n"),
}


@pytest.mark.parametrize("language", list(AROUND))
def test_tokens(spark, language):
    before, after = AROUND[language]
    text = f"{before}\nä = hue\nb = \"hue and cry\"\n{after}"
    rows = recover.tokens(spark.createDataFrame([("a", text)], "path string, text string"), language).where(F.col("text").contains("hue")).orderBy("offset").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("identifier", "hue"), ("string", "hue and cry")]
    raw = text.encode()
    assert [r["offset"] for r in rows] == [raw.index(b"= hue") + 2, raw.index(b'"hue and cry"')]
    for r in rows:
        line = raw.split(b"\n")[r["line"] - 1]
        assert raw[r["offset"] :].startswith(line[r["column"] - 1 :])


#: A tab, as each language may spell it, and spellings that are no tab there.
TABS = {"c": (["\\t", "\\11", "\\x09"], ["\\\\t"]), "go": (["\\t", "\\x09", "\\011", "\\u0009"], ["\\\\t"]), "python": (["\\t", "\\11", "\\x09", "\\u0009"], ["\\\\t"]), "javascript": (["\\t", "\\x09", "\\u{9}"], ["\\\\t"]), "rust": (["\\t", "\\x09", "\\u{9}"], ["\\\\t"]), "nim": (["\\t", "\\9", "\\x09"], ["\\\\t"]), "java": (["\\t", "\\11", "\\u0009"], ["\\x09", "\\\\t"]), "zig": (["\\t", "\\x09", "\\u{9}"], ["\\\\t"])}


def test_values_of_strings(spark):
    for language, (tabs, others) in TABS.items():
        files = spark.createDataFrame([(str(k), f'let q = "{t}-";') for k, t in enumerate([*tabs, *others])], "path string, text string")
        said = {int(r["path"]): r["text"] for r in recover.tokens(files, language).where("kind = 'string'").collect()}
        assert [said[k] == "\t-" for k in range(len(said))] == [True] * len(tabs) + [False] * len(others), language


def test_names_are_no_numbers(spark):
    text = 'var @"two words" = 0b11 + 7px + größe; const _a9 = 1e5;'
    rows = recover.tokens(spark.createDataFrame([("a", text)], "path string, text string"), "zig").where("kind = 'identifier'").orderBy("offset").collect()
    assert [r["text"] for r in rows] == ["var", "two words", "größe", "const", "_a9"]


def test_sequences(spark):
    text = "p::q <= r // s\n'u' v"
    rows = recover.tokens(spark.createDataFrame([("a", text)], "path string, text string"), "javascript", sequences=2).where("kind = 'sequence'").orderBy("offset", F.length("text")).collect()
    assert [r["text"] for r in rows] == ["p", "p ::", "::", ":: q", "q", "q <=", "<=", "<= r", "r", "v"]


@pytest.mark.parametrize("language", list(RULES))
def test_long_texts_of_openers(spark, language):
    """What opens and never closes: no stack, and time in proportion."""
    opened = ["(", "[", "{", "\"", "'", "`", "/*", "#[", "${`", "import {", "from x import (", "use y::{", "mod z {\n", "R\"w(", "if TYPE_CHECKING:\n ", "\\", "import(", "@import(", "#include <", "/["]
    files = spark.createDataFrame([(str(k), o * (6_000 // len(o))) for k, o in enumerate(opened)], "path string, text string").repartition(4)
    recover.imports(files, language).write.format("noop").mode("overwrite").save()
