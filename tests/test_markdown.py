"""Links of Markdown by way of definitions."""

from pyspark.sql import functions as F
from weftgraph.functions import markdown


def test_labels_fold_as_unicode_says(spark):
    """All letters that have a case, against the standard's full folding."""
    letters = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.strip() and (c.casefold() != c or c.isalpha())]
    rows = spark.createDataFrame([(c, c.casefold()) for c in letters], "c string, f string").select("f", markdown.folded(F.col("c")).alias("a"), markdown.folded(F.col("f")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    classes = {}
    for r in rows:
        classes.setdefault(r["a"], set()).add(r["f"])
    assert all(len(v) == 1 for v in classes.values())


def test_long_texts_of_openers(spark):
    opened = ["[", "[a", "[a](", "`", "[[", "[[a", "<!--", "```\n", "[a]: <", "[a]: (", "[a]: b \"", "[x][", "[a]: b\n", "[a] ", "\\"]
    files = spark.createDataFrame([(str(k), o * (40_000 // len(o))) for k, o in enumerate(opened)], "path string, text string").repartition(4)
    assert markdown.links(files).where("src <> '2'").count() == 0
