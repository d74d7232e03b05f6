"""From files to a graph: recover, resolve, type and count."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, names, paths, recover
from ..operators import gradle, manifests, resolve
from ..operators.graph import DependencyGraph, import_edges, link_edges
from ..sources.shared import settle

#: The kinds that imports can have.
IMPORT_KINDS = ("import", "type_only", "dynamic", "test")


@dataclass(frozen=True)
class ScanOptions:
    """kinds that are read; links and assets are asked for. test_paths: patterns of further test files."""

    kinds: tuple[str, ...] = IMPORT_KINDS
    languages: tuple[str, ...] = tuple(names.EXTENSIONS)
    include_roots: tuple[str, ...] = ()
    python_roots: tuple[str, ...] = ("",)
    python_initializers: str = "ancestors"
    python_star_reexports: bool = True
    nim_paths: tuple[str, ...] = ()
    named_modules: tuple[resolve.NamedModule, ...] = ()
    go_target: tuple[str, ...] | None = None
    strict_imports: bool = False
    test_paths: tuple[str, ...] = field(default=())


class UnsupportedImport(ValueError):
    """strict_imports: a construct whose target is not written out, with its path, offset and expression."""


def resolved(files: DataFrame, options: ScanOptions) -> DataFrame:
    """src, pos, ord, name, form, kind, dst of the imports of all languages. Branches of other languages are not planned."""
    found = []
    for lang in options.languages:
        own = files.where(names.language_of(F.col("path")) == lang)
        found.append(
            {
                "c": lambda f: resolve.c_files(f, options.include_roots),
                "javascript": lambda f: resolve.javascript_files(f, files),
                "python": lambda f: resolve.python_files(f, options.python_roots, options.python_initializers, options.python_star_reexports),
                "rust": resolve.rust_files,
                "nim": lambda f: resolve.nim_files(f, options.nim_paths, files),
                "zig": lambda f: resolve.zig_files(f, options.named_modules),
                "java": resolve.java_files,
                "go": lambda f: resolve.go_files(f, files, options.go_target),
            }[lang](own).select("src", "pos", "ord", "name", "form", "kind", "dst")
        )
    return reduce(DataFrame.unionByName, found)


def references(files: DataFrame, options: ScanOptions, hits: DataFrame | None = None) -> DataFrame:
    """src, pos, ord, name, member, kind and resolved of every reference that texts hold, files or not. Members are those
    of Zig imports, and mark wiki links."""
    hits = resolved(files, options) if hits is None else hits
    parts = []
    for lang in options.languages:
        own = files.where(names.language_of(F.col("path")) == lang)
        said = recover.imports(own, lang).select("src", "pos", "ord", "name", F.lit(None).cast("string").alias("member"), "kind")
        if lang == "zig":
            used = recover.zig_members(own).select("src", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("ord"), "name", "member", F.lit("import").alias("kind"))
            said = said.unionByName(used)
        parts.append(said)
    found = reduce(DataFrame.unionByName, parts)
    there = hits.select("src", "name", F.lit(True).alias("resolved")).distinct()
    return found.join(there.hint("merge"), ["src", "name"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def unsupported(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """path, offset, expression of the constructs whose target is not written out, of all languages and of Gradle."""
    said = (recover.unsupported(files.where(names.language_of(F.col("path")) == lang), lang) for lang in options.languages)
    return reduce(DataFrame.unionByName, said).unionByName(gradle.unsupported(files))


def invalid(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """path, cause, offset (in bytes, null if it is the whole file): files that are tolerated and contribute less than they
    might: manifests that break their grammar, configs that extend themselves, Go constraints that can't be read, go.mod and go.work whose blocks never close,
    imports of modules that a workspace replaces in different ways."""
    whole = F.lit(None).cast("long").alias("offset")
    configs = resolve.ts_configs(files).where("cycle").select(F.when(F.col("dir") == "", F.lit("tsconfig.json")).otherwise(F.concat("dir", F.lit("/tsconfig.json"))).alias("path"), F.lit("ConfigCycle").alias("cause"), whole)
    own = files.where(names.language_of(F.col("path")) == "go")
    go = resolve.go_selected(own, options.go_target).where("error is not null").select("path", F.col("error").alias("cause"), whole)
    bare = F.regexp_replace("text", r"//[^\n]*", "")
    open_ = F.size(F.regexp_extract_all(bare, F.lit(r"\("), F.lit(0))) > F.size(F.regexp_extract_all(bare, F.lit(r"\)"), F.lit(0)))
    broken = files.where(paths.basename("path").isin("go.mod", "go.work") & open_).select("path", F.lit("InvalidManifest").alias("cause"), whole)
    torn = resolve.go_conflicts(own, files, options.go_target).select("path", F.lit("ConflictingReplacement").alias("cause"), F.col("offset").cast("long"))
    return reduce(DataFrame.unionByName, (configs, go, broken, torn, manifests.invalid(files))).distinct()


def scan(files: DataFrame, options: ScanOptions = ScanOptions()) -> DependencyGraph:
    """files: path (normal), text. A test file makes its imports tests; in Go, Java and modules of Rust a test target
    does too. strict_imports: the first construct without a written target, by path and offset, stops the scan."""
    if options.strict_imports and (bad := unsupported(files, options).orderBy("path", "offset").head()):
        raise UnsupportedImport(f"{bad['path']}:{bad['offset']}: {bad['expression']}")
    is_test = lambda c: names.test_file(F.col(c)) | globs.any_of(F.col(c), options.test_paths)
    parts = []
    if set(options.kinds) & set(IMPORT_KINDS):
        hits = resolved(files, options)
        tests = lambda c: is_test(c)
        if "rust" in options.languages:
            hits = settle(hits, "hits")
            marked = resolve.rust_test_files(files.where(names.language_of(F.col("path")) == "rust"), hits.where(names.language_of(F.col("src")) == "rust")).withColumn("_t", F.lit(True)).distinct()
            hits = hits.join(marked.select(F.col("path").alias("src"), F.col("_t").alias("_from")).hint("merge"), "src", "left").join(marked.select(F.col("path").alias("dst"), F.col("_t").alias("_to")).hint("merge"), "dst", "left")
            tests = lambda c: is_test(c) | F.coalesce(F.col({"src": "_from", "dst": "_to"}[c]), F.lit(False))
        by_target = (names.language_of(F.col("src")).isin("go", "java") | (F.col("form") == "mod")) & tests("dst")
        found = hits.withColumn("kind", F.when(tests("src") | by_target, "test").otherwise(F.col("kind")))
        if not set(IMPORT_KINDS) <= set(options.kinds):  # a filter would have the kinds computed twice
            found = found.where(F.col("kind").isin(*options.kinds))
        found = found.withColumnRenamed("pos", "offset").withColumnRenamed("ord", "pos")
        parts.append(import_edges(found))
    if "link" in options.kinds:
        parts.append(link_edges(resolve.markdown_files(files)))
    if "asset" in options.kinds:
        own = files.where(names.asset_text(F.col("path")))
        parts.append(link_edges(resolve.asset_files(own, files)))
    # no empty table beside them: each of its partitions would wait for a Python worker
    parts = parts or [files.sparkSession.createDataFrame([], "src string, dst string, kind string, count long")]
    return DependencyGraph.from_edges(files.select("path"), reduce(DataFrame.unionByName, parts))
