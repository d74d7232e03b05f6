"""What keeps large inputs whole and spread: rows of one file over all cores, no table sent whole to the driver."""

import os

from pyspark.sql import functions as F
from weftgraph.functions import markdown, names, paths, recover
from weftgraph.operators import iterate, resolve
from weftgraph.operators.graph import DependencyGraph
from weftgraph.sources import cases, corpora, shared
from weftgraph.sources.shared import settle

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    for rows in (cases.keys(spark, SF), corpora.tree_rows(spark, SF)[0]):
        assert rows.rdd.getNumPartitions() > 1


def test_filters_do_not_reach_the_one_task_that_reads_a_file(spark):
    for rows in (cases.keys(spark, SF), corpora.tree_rows(spark, SF)[0]):
        assert "part.parquet" not in plan(rows.where(F.concat(F.col("k").cast("string"), F.lit(".ts")).rlike("1")))


def test_a_language_is_found_once(spark):
    rows = spark.range(3).select(F.element_at(F.array(*map(F.lit, ("a/_test.go", "src/xtest/A.java", ".py"))), (F.col("id") + 1).cast("int")).alias("path"))
    found = rows.select(names.language_of(F.col("path")).alias("lang"), names.test_file(F.col("path")).alias("test"))
    assert [tuple(r) for r in found.collect()] == [("go", True), ("java", True), (None, False)]
    assert len(found.select("test")._jdf.queryExecution().analyzed().toString()) < 4_000


def test_a_settled_table_is_not_broadcast(spark):
    rows = spark.range(10).withColumnRenamed("id", "a")
    for how in ("inner", "left", "left_anti"):
        assert "Broadcast" not in plan(rows.join(settle(rows).select("a").distinct(), "a", how))


def test_references_and_definitions_meet_without_a_broadcast(spark):
    files = spark.createDataFrame([("a.md", "[x]: b.md\n\n[x]\n")], "path string, text string")
    found = markdown.links(files)
    assert "Broadcast" not in plan(found)
    assert [r["name"] for r in found.collect()] == ["b.md"]


def test_an_expression_named_often_is_computed_once(spark):
    # written out anew at each place, a text that says itself twice doubles with every step
    c = F.col("p")
    for _ in range(12):
        c = paths.joined(paths.dirname(c), F.lit("x/y"))
    rows = spark.createDataFrame([("a/b",)], "p string").select(c.alias("p"))
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 20_000


def test_candidates_are_joined_by_their_digest(spark):
    files = spark.createDataFrame([("a/x.ts", "import './y'; import './gone'; import '../a/y';\n"), ("a/y.ts", ""), ("y.ts", "")], "path string, text string")
    specs = recover.imports(files, "javascript")
    none = F.lit(None).cast("string")
    found = resolve.ranked(specs, files, F.array(none, F.concat(F.lit("a/"), "name", F.lit(".ts")), F.when(F.col("name") != "./gone", "a/y.ts"), F.lit(None).cast("string")))
    assert sorted(r["name"] for r in found.where("dst = 'a/y.ts'").collect()) == ["../a/y", "./y"]


def test_a_chain_holds_only_what_its_start_reaches(spark, monkeypatch):
    # a hundred files lead to the end, the start passes two of them
    rows = [(f"n{i}", "end") for i in range(100)] + [("start", "m"), ("m", "n7"), ("n7", "start")]
    edges = spark.createDataFrame([(a, b, "import", 1) for a, b in rows], "src string, dst string, kind string, count long")
    paths_ = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    sizes, settle_ = [], iterate.settle

    def seen(df, name="step"):
        out = settle_(df, name)
        if "way" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(iterate, "settle", seen)
    assert iterate.chain(DependencyGraph(paths_, edges), "start", "end").collect()[0]["chain"] == ["start", "m", "n7", "end"]
    assert max(sizes) <= 4


def test_a_closure_leaves_the_table_of_its_last_round_only(spark):
    before = len(shared._WRITTEN)
    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    assert iterate.closure(pairs).count() == 45
    own = [path.removeprefix("file://") for _, path in shared._WRITTEN[before:]]
    assert len(own) > 3 and [os.path.exists(path) for path in own] == [False] * (len(own) - 1) + [True]
