"""What a scan of texts does once, or not at all."""

import random

import pytest
from pyspark.sql import functions as F
from weftgraph.functions import recover
from weftgraph.sources import cases

PIECES = (
    " \t|\t|\n|\r\n|\f|\v| |\\\n|\\|/|//|/*|*/|#|##|#[|]#|#![|\"|\"\"\"|'|'''|`|${|}|{|(|)|[|]|;|,|.|:|::|=|@|é|x|R\"t(|)t\"|u8R\"(|r#\"|\"#|br\"|"
    "import|import type|export|from|require(|typeof import(|#include|# include|if TYPE_CHECKING:\n    |__import__(|importlib.import_module(|use a::|mod b;|pub mod|pub(crate) mod c {|extern crate d|include!(|"
    "include|package p;|Class.forName(|. loadClass(|.loadClass(|static|const e =|var f =|@import(|return|g|H|/[/]/.test(|\\\\z"
).split("|")


@pytest.mark.parametrize("language", sorted(recover.STATEMENTS))
def test_a_scan_stops_where_it_would_without_a_look_ahead(spark, language):
    draw = random.Random(language)
    texts = ["".join(draw.choice(PIECES) + draw.choice(("", "", " ")) for _ in range(draw.randrange(1, 40))) for _ in range(1500)]
    texts += [t for t, _ in cases.IMPORTS[language]] + PIECES
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = f"({recover.STATEMENTS[language]})|{recover.SKIPPED[language]}"
    tiles = lambda p: F.array(*(F.regexp_extract_all("text", F.lit(f"(?m)(?s:.*?)(?:{p}|\\z)"), F.lit(k)) for k in (0, 1)))
    found = rows.select("text", tiles(whole).alias("plain"), tiles(f"(?={recover.FIRST[language]})(?:{whole})").alias("ahead"))
    assert found.where("plain <> ahead").collect() == []
    assert found.where("exists(plain[1], s -> s <> '')").head() is not None


def test_texts_in_templates_are_matched_once(spark, monkeypatch):
    tables, settle = [], recover.settle
    monkeypatch.setattr(recover, "settle", lambda df, name="step": tables.append(name) or settle(df, name))
    files = spark.createDataFrame([("a.ts", "x = `${ import('./a') } ${ `${ require('./b') }` }`; import './c'")], "path string, text string")
    assert sorted(r["name"] for r in recover.imports(files, "javascript").collect()) == ["./a", "./b", "./c"]
    assert tables == ["statements"] * 3


def test_a_name_is_taken_from_its_statement_once(spark):
    rows = spark.createDataFrame([("import static a.B.*;",), ("import /* x */ c . D;",), ("import static;",)], "s string")
    found = rows.select("s", recover._specs(F.col("s"), "java").alias("x"))
    assert {r["s"]: [tuple(x) for x in r["x"]] for r in found.collect()} == {"import static a.B.*;": [("a.B.*", "static_star")], "import /* x */ c . D;": [("c.D", "literal")], "import static;": [("static", "literal")]}
    assert found._jdf.queryExecution().analyzed().toString().count("import (?:static )?") == 1
