"""Manifests: Gradle's scripts as they nest, and what breaks a grammar."""

import pytest
from weftgraph.operators import gradle, manifests
from weftgraph.plans.scan import ScanOptions, invalid


def said(spark, path, text):
    files = spark.createDataFrame([(path, text)], "path string, text string")
    found = [(r["grp"], r["name"], r["requirement"], r["origin"]) for r in manifests.gradle(files).collect()]
    computed = [text.encode()[r["offset"] :].split(b"\n")[0].decode() for r in gradle.unsupported(files).orderBy("offset").collect()]
    return found, computed


@pytest.mark.parametrize(
    ("path", "text", "found", "computed"),
    [
        ("build.gradle", 'dependencies {\n  api "a:b:${ xs.find { it == "}" }.v + "${\'"\'}" }"\n  api \'c:d:1\'\n}\n', [("api", "c:d", "1", "registry")], ['api "a:b:${ xs.find { it == "}" }.v + "${\'"\'}" }"']),
        ("build.gradle", "dependencies {\n )\n ] api 'a:b:1'\n}", [("api", "a:b", "1", "registry")], [")", "] api 'a:b:1'"]),
        ("build.gradle", "dependencies { api(", [], ["api("]),
        ("build.gradle", "x.dependencies { api 'a:b:1' }\n'''dependencies { api 'c:d:1' }'''", [], []),
        ("build.gradle", "dependencies { api 'open\n api 'a:b:$raw' }", [("api", "a:b", "$raw", "registry")], ["api 'open"]),
        ("x/build.gradle.kts", '#!/usr/bin/env kotlin\n/* /* dependencies { api("a:b:1") } */ */\ndependencies { "odd"("c:d:2") { isTransitive = false }; api(kotlin("test")) }', [("odd", "c:d", "2", "registry")], ['api(kotlin("test")) }']),
        ("x/build.gradle.kts", "dependencies {\n `when`(project(path = \":é\"))\n api('a:b:1')\n}", [("when", ":é", "", "workspace")], ["api('a:b:1')"]),
    ],
)
def test_gradle(spark, path, text, found, computed):
    assert said(spark, path, text) == (found, computed)


def test_invalid(spark):
    files = [("a/package.json", '{"dependencies": {'), ("b/package.json", "{}"), ("c/Cargo.toml", '"é" = 1\n[a]\nb = "c\nd = 2\n'), ("d/pyproject.toml", "[project]\ndependencies = [\n  'a>=1', # why\n]\n"), ("e/go.mod", "module e\nrequire (\n"), ("f/Cargo.toml", None)]
    rows = invalid(spark.createDataFrame(files, "path string, text string"), ScanOptions(languages=("go",))).collect()
    assert sorted((r["path"], r["cause"], r["offset"]) for r in rows if r["path"] != "e/go.mod") == [("a/package.json", "InvalidManifest", None), ("c/Cargo.toml", "InvalidManifest", 13)]
    assert [(r["cause"], r["offset"]) for r in rows if r["path"] == "e/go.mod"] == [("InvalidManifest", None)]


def test_long_texts(spark):
    opened = ["a = [", "[", "a = {b = ", '"', "'''", "a = 1\n", "a.", "# \n"]
    files = spark.createDataFrame([(f"{k}/Cargo.toml", o * (40_000 // len(o))) for k, o in enumerate(opened)], "path string, text string")
    assert manifests.invalid(files).count() == 6
