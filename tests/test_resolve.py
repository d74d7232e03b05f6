"""Resolution where texts mislead."""

from weftgraph.operators import resolve


def test_exports_are_code(spark):
    files = [
        ("a/__init__.py", '"""Example:\n__all__ = ["no"]\n"""\n# __all__ = ["no"]\nfrom .m import no, yes\n__all__ = [  # "no"\n    "yes",\n]\n'),
        ("a/m.py", ""),
        ("b/__init__.py", "from .n import some\n__all__: list[str] = ('some',)\n"),
        ("b/n.py", ""),
    ]
    rows = resolve.python_exports(spark.createDataFrame(files, "path string, text string")).collect()
    at = {p: t for p, t in files}
    assert {(r["path"], at[r["path"]][r["pos"] :].split("\n")[0]) for r in rows} == {("a/__init__.py", "from .m import no, yes"), ("b/__init__.py", "from .n import some")}
    alone = spark.createDataFrame([("c/__init__.py", '"""\n__all__ = ["no"]\n"""\nfrom .m import no\n')], "path string, text string")
    assert resolve.python_exports(alone).count() == 0
