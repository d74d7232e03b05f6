"""References to files as ranked equi-joins.

A reference has candidates, the paths it may mean in their order. Candidates are exploded with their rank, joined
with the files, and the least rank wins. Nearest ancestors and longest prefixes are the same join over exploded
directories and prefixes. Both sides of every join grow with the corpus, so none is broadcast here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, recover
from ..functions import paths as P
from ..sources.shared import settle

KEY = ("src", "pos", "ord")


def ranked(specs: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """specs with dst: the first candidate that is a file. Specs without one are left out.

    Many references have the same candidates, as all imports of one module by its full name, and most of those name no
    file. So distinct candidates meet the files, and references meet what was found: a table, so that Spark can split
    the join where one name is on many rows. A digest stands for the candidates, which are long."""
    rows = specs.withColumn("_c", F.filter(candidates, lambda c: c.isNotNull()))
    rows = settle(rows.withColumn("_k", F.unhex(F.md5(F.to_json("_c").cast("binary")))), "specs")
    each = rows.select("_k", "_c").where(F.size("_c") > 0).dropDuplicates(["_k"]).select("_k", F.posexplode("_c").alias("_rank", "dst"))
    hit = each.join(files.select(F.col("path").alias("dst")).distinct().hint("merge"), "dst")
    found = settle(hit.groupBy("_k").agg(F.min(F.struct("_rank", "dst")).alias("_m")).select("_k", F.col("_m.dst").alias("dst")), "found")
    return rows.join(found, "_k").select(*specs.columns, "dst")


def nearest(rows: DataFrame, path: str, there: DataFrame) -> DataFrame:
    """rows with the columns of there (dir, ...) of the nearest directory at or above `path` that is in there."""
    id_ = F.monotonically_increasing_id()
    up = rows.withColumn("_id", id_).withColumn("dir", F.explode(P.ancestors(path, root=True)))
    deepest = F.rank().over(Window.partitionBy("_id").orderBy(F.desc(F.when(F.col("dir") == "", -1).otherwise(F.length("dir")))))
    return up.join(there.hint("merge"), "dir").withColumn("_n", deepest).where("_n = 1").drop("_n", "_id")


def _endings(base: Column, endings) -> Column:
    return F.array(*(F.concat(base, F.lit(e)) for e in endings))


def c_files(files: DataFrame, include_roots: tuple[str, ...] = ()) -> DataFrame:
    specs = recover.imports(files, "c")
    return ranked(specs, files, F.array(P.joined(P.dirname("src"), F.col("name")), *(P.joined(F.lit(r), F.col("name")) for r in include_roots)))


# What a JavaScript name is completed with, in order, and what takes the place of a runtime extension.
JS_ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".d.mts", ".mjs", ".cts", ".d.cts", ".cjs", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx")
JS_SWAPS = {".js": (".ts", ".tsx", ".d.ts", ".js", ".jsx"), ".jsx": (".ts", ".tsx", ".d.ts", ".js", ".jsx"), ".mjs": (".mts", ".d.mts", ".mjs"), ".cjs": (".cts", ".d.cts", ".cjs")}


def _js_names(root: Column, name: Column) -> Column:
    """The files that a name may mean as seen from root: a runtime extension is swapped, any other name completed."""
    parts = F.struct(
        F.regexp_extract(name, r"[^/](\.(?:js|jsx|mjs|cjs))$", 1).alias("ends"),
        P.joined(root, F.regexp_replace(name, r"\.(?:js|jsx|mjs|cjs)$", "")).alias("bare"),
        P.joined(root, name).alias("base"),
    )

    def completed(x: Column) -> Column:
        found = _endings(x["base"], JS_ENDINGS)
        for e, swaps in JS_SWAPS.items():
            found = F.when(x["ends"] == e, _endings(x["bare"], swaps)).otherwise(found)
        return found

    # bound as an element: paths are joined once and not once for every ending
    return F.flatten(F.transform(F.array(parts), completed))


def _jsonc(text: Column) -> Column:
    """JSON of a text with comments and trailing commas."""
    string = r'("(?:[^"\\]|\\.)*+")'
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), rf"{string}|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", "$1")
    return F.regexp_replace(plain, rf"{string}|,(?=\s*+[}}\]])", "$1")


CONFIG = "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def ts_configs(files: DataFrame) -> DataFrame:
    """dir, base, paths_root, paths and cycle of the config that governs each directory: its own options over those of
    what it extends, later parents over earlier ones; a child's paths replace a parent's. A config that extends itself
    by way of others has cycle set, and keeps what the others say."""
    held = files.where(F.endswith("path", F.lit(".json")) & (F.col("text").contains("compilerOptions") | F.col("text").contains("extends")))
    own = held.select("path", F.from_json(_jsonc(F.col("text")), CONFIG).alias("j")).select("path", "j.extends", "j.compilerOptions.baseUrl", "j.compilerOptions.paths")
    listed = F.when(F.startswith("extends", F.lit("[")), F.from_json("extends", "array<string>")).when(F.col("extends").isNotNull(), F.array("extends"))
    own = settle(own.withColumn("extends", listed), "configs")
    parent = P.joined(P.dirname("path"), F.concat("name", F.when(F.endswith("name", F.lit(".json")), "").otherwise(".json")))
    ups = own.select("path", F.posexplode("extends").alias("n", "name")).where(F.col("name").rlike(r"^\.{1,2}/")).select(F.col("path").alias("at"), F.col("n").cast("int").alias("n"), parent.alias("up"))
    walk = own.where(P.basename("path").isin("tsconfig.json", "jsconfig.json")).select("path", F.col("path").alias("at"), F.array().cast("array<int>").alias("key"), F.array("path").alias("way"), F.lit(False).alias("cycle"))
    every, front = walk, walk
    while True:
        # what is nearer in the order own, last parent, its parents, the parent before it has the lesser key
        front = settle(front.where("not cycle").join(ups, "at").select("path", F.col("up").alias("at"), F.concat("key", F.array(-F.col("n"))).alias("key"), F.concat("way", F.array("up")).alias("way"), F.array_contains("way", F.col("up")).alias("cycle")), "configs")
        if front.head() is None:
            break
        every = every.unionByName(front)
    said = every.join(own.withColumnRenamed("path", "at"), "at")
    base = F.when(F.col("baseUrl").isin(".", "./"), P.dirname("at")).otherwise(P.joined(P.dirname("at"), F.col("baseUrl")))
    key = F.col("key")
    merged = said.where("not cycle").groupBy("path").agg(
        F.min_by(base, F.when(F.col("baseUrl").isNotNull(), key)).alias("base"),
        F.min_by(F.struct(P.dirname("at").alias("root"), F.map_entries("paths").alias("entries")), F.when(F.col("paths").isNotNull(), key)).alias("p"),
    )
    looped = every.where("cycle").select("path").distinct().withColumn("cycle", F.lit(True))
    merged = merged.join(looped, "path", "left").withColumn("dir", P.dirname("path"))
    best = merged.groupBy("dir").agg(F.min_by(F.struct("base", F.col("p.root").alias("paths_root"), F.col("p.entries").alias("paths"), "cycle"), F.when(P.basename("path") == "tsconfig.json", 0).otherwise(1)).alias("c"))
    return best.select("dir", "c.base", "c.paths_root", "c.paths", F.coalesce("c.cycle", F.lit(False)).alias("cycle"))


def javascript_files(files: DataFrame, all_files: DataFrame | None = None) -> DataFrame:
    """Relative names from beside the importer; other names by the aliases and the base of the nearest config: of the
    patterns that match the exact one, or the one with the longest part before its star, its targets in order."""
    specs = recover.imports(files, "javascript")
    near = specs.where(F.col("name").rlike(r"^\.{1,2}/"))
    hits = ranked(near, files if all_files is None else all_files, _js_names(P.dirname("src"), F.col("name")))
    if all_files is None:
        return hits
    configs = settle(ts_configs(all_files), "configs")
    if configs.head() is None:
        return hits
    far = nearest(specs.where(~F.col("name").rlike(r"^\.{1,2}/")), "src", configs)
    star = lambda e: F.locate("*", e["key"])
    head, tail = (lambda e: F.substring_index(e["key"], "*", 1)), (lambda e: F.substring(e["key"], star(e) + 1, F.length(e["key"])))
    name = F.col("name")
    fits = lambda e: F.when(star(e) > 0, F.startswith(name, head(e)) & F.endswith(name, tail(e)) & (F.length(name) >= F.length(head(e)) + F.length(tail(e)))).otherwise(name == e["key"])
    scored = F.transform("paths", lambda e, i: F.struct(F.when(star(e) > 0, star(e)).otherwise(1 << 30).alias("score"), (-i).alias("n"), e.alias("e"), fits(e).alias("fits")))
    best = F.array_max(F.transform(F.filter(scored, lambda x: x["fits"]), lambda x: F.struct(x["score"], x["n"], x["e"].alias("e"))))
    far = far.withColumn("_e", best["e"])
    pattern = F.col("_e")["key"]
    capture = F.when(pattern.contains("*"), F.substring(name, F.locate("*", pattern), F.length(name) - F.length(pattern) + 1)).otherwise("")
    at = F.coalesce("base", "paths_root")
    aliased = F.flatten(F.transform(F.col("_e")["value"], lambda t: _js_names(at, F.replace(t, F.lit("*"), capture))))
    none = F.array().cast("array<string>")
    based = F.when(F.col("base").isNotNull(), _js_names(F.col("base"), name)).otherwise(none)
    return hits.unionByName(ranked(far, all_files, F.concat(F.coalesce(aliased, none), based)).select(*hits.columns))


def python_exports(files: DataFrame) -> DataFrame:
    """path, dst: for a package or module with a literal __all__, the modules that define the names it lists."""
    # tiles that pass over comments and long strings as a whole, so that an __all__ in one is never seen
    bracket = r"[\[(](?:[^\])#]|#[^\n]*+)*+[\])]"
    tile = rf"(?m)(?s:.*?)(?:^__all__\s*+(?::[^=\n]*+)?=\s*+({bracket})|{recover.SKIPPED['python']}|\z)"
    listed = F.regexp_replace(F.array_join(F.regexp_extract_all("text", F.lit(tile), F.lit(1)), " "), r"#[^\n]*", " ")
    names = files.where(F.col("text").contains("__all__")).select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"[\"']([A-Za-z_]\w*)[\"']"), F.lit(1))).alias("export"))
    members = recover.imports(files, "python").where("form = 'member'")
    return members.select(F.col("src").alias("path"), F.substring_index("name", ".", -1).alias("export"), "pos").join(names.hint("merge"), ["path", "export"]).select("path", "pos").distinct()


def python_files(files: DataFrame, roots: tuple[str, ...] = ("",), initializers: str = "ancestors", star_reexports: bool = True) -> DataFrame:
    """A name is a module file or a package's __init__; packages above it are imported too where they have one.

    initializers: "explicit" leaves a base out whose names are all modules; "modulefinder" adds the packages above to
    names of dots only. star_reexports: `from x import *` also means the modules that x takes the names of its __all__ from."""
    specs = recover.imports(files, "python")
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace("name", r"^\.+", ""), r"\.", "/")
    dir_ = P.dirname("src")
    parts = F.split(dir_, "/")
    depth = F.when(dir_ == "", 0).otherwise(F.size(parts))
    anchor = F.array_join(F.slice(parts, F.lit(1), F.greatest(depth - dots + 1, F.lit(0))), "/")
    # an anchor at the search root that holds the importer, or above it, is in no package
    boundary = F.array_max(F.array(*(F.when(P.within(F.lit(r), dir_), F.when(F.lit(r) == "", 0).otherwise(r.count("/") + 1)).otherwise(0) for r in roots), F.lit(0)))
    inside = (dots > 0) & (depth - dots + 1 > boundary)
    relative = F.when(inside, F.when(rest == "", anchor).otherwise(F.concat(anchor, F.lit("/"), rest)))
    absolute = [F.when((dots == 0) & (rest != ""), rest if r == "" else F.concat(F.lit(f"{r}/"), rest)) for r in roots]
    found = F.flatten(F.filter(F.array(*(_endings(b, (".py", "/__init__.py")) for b in (relative, *absolute))), lambda c: c.isNotNull()))
    hits = settle(ranked(specs, files, found), "hits")
    if initializers == "explicit":
        named = specs.where("form = 'member'").join(hits.select(*KEY, F.lit(1).alias("hit")), list(KEY), "left")
        whole = named.groupBy("src", "pos").agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("all")).where("hit = all")
        return hits.join(whole.withColumn("form", F.lit("base")).select("src", "pos", "form"), ["src", "pos", "form"], "left_anti")
    # packages above the target: of absolute names all, of relative ones those below the anchor
    lowest = F.when(dots == 0, 0).otherwise(F.when(F.lit(initializers == "modulefinder") & (rest == ""), boundary).otherwise(depth - dots + 1))
    kept = F.filter(P.ancestors("dst"), lambda d: F.size(F.split(d, "/")) > lowest)
    above = hits.select(*specs.columns, F.explode(F.transform(kept, lambda d: F.concat(d, F.lit("/__init__.py")))).alias("dst"))
    out = hits.unionByName(above.join(files.select(F.col("path").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select(*hits.columns))
    if star_reexports:
        exports = python_exports(files)
        implied = hits.select(F.col("src").alias("path"), "pos", F.col("dst").alias("to")).where("to is not null").join(exports.hint("merge"), ["path", "pos"]).select("path", F.col("to").alias("more")).distinct()
        stars = hits.where("form = 'star'").join(implied.withColumnRenamed("path", "dst").hint("merge"), "dst").drop("dst").withColumnRenamed("more", "dst")
        out = out.unionByName(stars.select(*hits.columns))
    return out.distinct()


def rust_files(files: DataFrame) -> DataFrame:
    """mod names a file below the module; use the longest prefix of its path that is a file. Crates name none."""
    specs = recover.imports(files, "rust").where("form in ('mod', 'use')")
    file_dir = F.when(F.col("src").rlike(r"(^|/)(mod|lib|main)\.rs$"), P.dirname("src")).otherwise(F.regexp_replace("src", r"\.rs$", ""))
    own_dir = F.when(F.col("scope") == "", file_dir).when(file_dir == "", F.col("scope")).otherwise(F.concat(file_dir, F.lit("/"), "scope"))
    # the crate's root is the nearest directory named src, or the top
    crate = F.regexp_extract("src", r"^((?:.*/)?src)/", 1)
    segments = F.split("name", "::")
    supers = F.size(F.filter(segments, lambda s: s == "super"))
    tail = F.filter(segments, lambda s: ~s.isin("crate", "self", "super"))
    up = F.split(own_dir, "/")
    base = F.when(segments[0] == "crate", crate).when(segments[0] == "super", F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - supers, F.lit(0))), "/")).otherwise(own_dir)
    under = lambda b, t: F.when(b == "", t).otherwise(F.concat(b, F.lit("/"), t))
    prefixes = F.when(F.size(tail) > 0, F.transform(F.sequence(F.size(tail), F.lit(1)), lambda n: under(base, F.array_join(F.slice(tail, F.lit(1), n), "/"))))
    used = F.flatten(F.transform(prefixes, lambda p: _endings(p, (".rs", "/mod.rs"))))
    empty = F.array().cast("array<string>")
    return ranked(specs, files, F.when(F.col("form") == "mod", _endings(under(own_dir, F.col("name")), (".rs", "/mod.rs"))).otherwise(F.coalesce(used, empty)))


def rust_test_files(files: DataFrame, hits: DataFrame) -> DataFrame:
    """path: files that declare cfg(test) for themselves, modules declared in test code, and all modules below them."""
    own = files.where(F.col("text").rlike(r"(?m)^\s*#!\[\s*cfg\s*\(\s*test\s*\)\s*\]")).select("path")
    mods = settle(hits.where("form = 'mod'").select("src", "dst", "kind"), "mods")
    seen = settle(own.unionByName(mods.where("kind = 'test'").select(F.col("dst").alias("path"))).distinct(), "tests")
    front = seen
    while front.head() is not None:
        front = settle(mods.join(front.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct().join(seen, "path", "left_anti"), "tests")
        seen = seen.unionByName(front)
    return seen


def nim_configs(files: DataFrame) -> DataFrame:
    """dir, n, root: search paths that Nim's configs add for what lies in their directory, in the order they are said."""
    config = F.col("path").rlike(r"(^|/)(nim\.cfg|config\.nims|[^/]+\.nim\.cfg|[^/]+\.nims)$")
    bare = F.regexp_replace("text", r"(?m)^\s*#[^\n]*$", "")
    said = files.where(config).select("path", F.posexplode(F.regexp_extract_all(bare, F.lit(r"""(?m)^\s*(?:--?|switch\s*\(\s*")?(?:path|p)(?:"\s*,\s*"|\s*[:=]\s*"?)([^"\s)#]+)"""), F.lit(1))).alias("n", "raw"))
    root = F.when(F.col("raw") == ".", P.dirname("path")).otherwise(P.joined(P.dirname("path"), F.col("raw")))
    return said.where(~F.col("raw").contains("$")).select(P.dirname("path").alias("dir"), "n", root.alias("root")).where("root is not null")


def nim_files(files: DataFrame, search: tuple[str, ...] = (), all_files: DataFrame | None = None) -> DataFrame:
    """Beside the importer, then on the search paths: those of nearer configs first, and of one config the last first."""
    specs = recover.imports(files, "nim").where(~F.col("name").rlike("^std/"))
    plain = F.regexp_replace("name", "^pkg/", "")
    full = F.when(P.basename(plain).contains("."), plain).otherwise(F.concat(plain, F.lit(".nim")))
    package, dotted = F.startswith("name", F.lit("pkg/")), F.startswith("name", F.lit("."))
    none = F.array().cast("array<string>")
    if all_files is not None:
        configs = nim_configs(all_files).groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "root")), False), lambda x: x["root"]).alias("roots"))
        up = specs.select("src").distinct().select("src", F.explode(P.ancestors("src", root=True)).alias("dir")).join(configs.hint("merge"), "dir")
        near = up.groupBy("src").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.when(F.col("dir") == "", -1).otherwise(F.length("dir")).alias("far"), "roots")), False), lambda x: x["roots"])).alias("roots"))
        specs = specs.join(near.hint("merge"), "src", "left")
    else:
        specs = specs.withColumn("roots", none)
    beside = F.when(~package, P.joined(P.dirname("src"), full))
    given = F.concat(F.coalesce("roots", none), F.array(*map(F.lit, search)).cast("array<string>"))
    there = F.when(dotted & ~package, none).otherwise(F.transform(given, lambda r: P.joined(r, full)))
    return ranked(specs, files, F.concat(F.array(beside), there)).drop("roots")


@dataclass(frozen=True)
class NamedModule:
    """A name that Zig files matching `source` import for the file `path`."""

    name: str
    path: str
    source: str = "**"


def zig_files(files: DataFrame, named: tuple[NamedModule, ...] = ()) -> DataFrame:
    """A file beside the importer, or the first named module of that name whose pattern has the importer."""
    specs = recover.imports(files, "zig")
    own = F.when(F.col("name").rlike(r"\.(zig|zon)$"), P.joined(P.dirname("src"), F.col("name")))
    for m in reversed(named):
        own = F.when((F.col("name") == m.name) & globs.matches(F.col("src"), m.source), F.lit(m.path)).otherwise(own)
    return ranked(specs, files, F.array(own))


def java_files(files: DataFrame) -> DataFrame:
    """The longest package that has the type; a star is every file of a package, or else of the type."""
    specs = recover.imports(files, "java").withColumn("_name", F.regexp_replace("name", r"\.\*$", ""))
    index = settle(recover.java_packages(files).select(F.col("path").alias("dst"), "package", "simple"), "packages")
    parts = F.split("_name", r"\.")
    types = F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda n: F.struct((F.size(parts) - n).alias("rank"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("package"), F.get(parts, n).alias("simple")))
    types = F.when(F.size(parts) > 1, types).otherwise(F.array().cast("array<struct<rank:int,package:string,simple:string>>"))
    rows = settle(specs, "specs")
    typed = rows.select(*specs.columns, F.inline(types)).join(index, ["package", "simple"]).select(*specs.columns, "rank", "dst")
    whole = rows.where("form = 'star'").withColumn("package", F.col("_name")).join(index, "package").select(*specs.columns, F.lit(0).alias("rank"), "dst")
    least = F.min("rank").over(Window.partitionBy(*KEY))
    return typed.unionByName(whole).withColumn("_least", least).where("rank = _least").select(*specs.columns, "dst").drop("_name")


def _go_lines(files: DataFrame, base: str, word: str) -> DataFrame:
    """dir and line of what a directive of go.mod or go.work says, in a block or alone, without comments."""
    text = F.regexp_replace("text", r"//[^\n]*", "")
    blocks = F.regexp_extract_all(text, F.lit(rf"(?ms)^\s*{word}\s*\((.*?)\)"), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{word}\s+([^(\s][^\n]*)$"), F.lit(1))
    lines = F.transform(F.split(F.array_join(F.concat(blocks, alone), "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r'["\r]', "")))
    return files.where(P.basename("path") == base).select(P.dirname("path").alias("dir"), F.explode(F.filter(lines, lambda x: x != "")).alias("line"))


def go_modules(manifests: DataFrame) -> DataFrame:
    """dir, module of every go.mod (path, text)."""
    return _go_lines(manifests, "go.mod", "module").select("dir", F.regexp_extract("line", r"^(\S+)", 1).alias("module")).where("module <> ''").dropDuplicates(["dir"])


def go_roots(manifests: DataFrame, modules: DataFrame) -> DataFrame:
    """owner, prefix, root, main, conflict: from files of the module in the directory `owner`, names below `prefix` are
    packages below `root`. Main ones are the module itself and what a workspace uses beside it; the others are replacements,
    of the version that is required or of any: a workspace's own, or else those of all modules that it uses. If these
    differ, conflict is set and there is no root; nor is there one for a replacement by no directory."""
    under = lambda d, p: F.when(p.isin(".", "./"), d).otherwise(P.joined(d, p))
    used = _go_lines(manifests, "go.work", "use").select(F.col("dir").alias("work"), under(F.col("dir"), F.col("line")).alias("dir"))
    members = used.join(modules, "dir")
    beside = used.select("work", F.col("dir").alias("owner")).join(members, "work").select("owner", F.col("module").alias("prefix"), F.col("dir").alias("root"))
    main = modules.select(F.col("dir").alias("owner"), F.col("module").alias("prefix"), F.col("dir").alias("root")).unionByName(beside).distinct().withColumn("main", F.lit(2))
    shape = r"^(\S+)\s*(\S*)\s*=>\s*(\S+)\s*(\S*)$"
    split = lambda df: df.select("dir", *(F.regexp_extract("line", shape, k).alias(c) for k, c in ((1, "prefix"), (2, "version"), (3, "to")))).where("to <> ''")
    local = F.when(F.col("to").rlike(r"^\.{1,2}(/|$)"), under(F.col("dir"), F.col("to"))).otherwise("").alias("root")
    need = _go_lines(manifests, "go.mod", "require").select(F.col("dir").alias("owner"), F.regexp_extract("line", r"^(\S+)", 1).alias("prefix"), F.regexp_extract("line", r"^\S+\s+(\S+)", 1).alias("need"))
    said = settle(split(_go_lines(manifests, "go.mod", "replace")).select("dir", "prefix", "version", local), "replacements")
    work = used.select("work", F.col("dir").alias("owner")).distinct()
    chosen = Window.partitionBy("owner", "prefix").orderBy(F.when(F.col("version") != "", 0).otherwise(1))

    def fitting(rows: DataFrame) -> DataFrame:
        """Of the replacements that an owner meets the one of the version it requires, or else that of any."""
        fits = rows.join(need, ["owner", "prefix"], "left").where("version = '' or version = need")
        return fits.withColumn("_n", F.row_number().over(chosen)).where("_n = 1")

    alone = said.withColumnRenamed("dir", "owner").join(work, "owner", "left_anti")
    own = fitting(alone).select("owner", "prefix", "root", F.lit(0).alias("main"), F.lit(False).alias("conflict"))
    # modules of a workspace that replace alike count once, so that owners meet what differs only
    each = said.join(used, "dir").groupBy("work", "dir", "prefix").agg(F.sort_array(F.collect_set(F.struct("version", "root"))).alias("entries")).select("work", "prefix", "entries").distinct()
    met = need.join(work, "owner").join(each, ["work", "prefix"])
    exact = F.filter("entries", lambda e: e["version"] == F.col("need"))
    any_ = F.filter("entries", lambda e: e["version"] == "")
    route = F.coalesce(F.get(exact, F.lit(0)), F.get(any_, F.lit(0)))["root"]
    routes = met.withColumn("root", route).where("root is not null").groupBy("owner", "prefix").agg(F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("conflict"))
    routes = routes.select("owner", "prefix", F.when(F.col("conflict"), "").otherwise(F.col("root")).alias("root"), F.lit(0).alias("main"), "conflict")
    over = split(_go_lines(manifests, "go.work", "replace")).select(F.col("dir").alias("work"), "prefix", "version", local)
    shared = fitting(work.join(over, "work")).select("owner", "prefix", "root", F.lit(1).alias("main"), F.lit(False).alias("conflict"))
    best = Window.partitionBy("owner", "prefix").orderBy(F.desc("main"))
    one = own.unionByName(routes).unionByName(shared).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return main.withColumn("conflict", F.lit(False)).unionByName(one.where("root <> '' or conflict"))


# The systems and architectures that file names and constraints know, and tags that others imply.
GO_SYSTEMS = "aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split()
GO_MACHINES = "386 amd64 amd64p32 arm armbe arm64 arm64be loong64 mips mipsle mips64 mips64le mips64p32 mips64p32le ppc ppc64 ppc64le riscv riscv64 s390 s390x sparc sparc64 wasm".split()
GO_UNIX = "aix android darwin dragonfly freebsd hurd illumos ios linux netbsd openbsd solaris".split()
GO_IMPLIED = {"android": "linux", "illumos": "solaris", "ios": "darwin"}


def holds(expression: Column, tags: tuple[str, ...]) -> Column:
    """Whether a build constraint (! && || and brackets over tags) holds; null where it is malformed."""
    pieces = F.regexp_extract_all(expression, F.lit(r"[\w.]+|&&|\|\||[!()]|\S"), F.lit(0))
    flat = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[\w.]+$"), F.when(p.isin(*tags), "T").otherwise("F")).otherwise(p)), "")

    def reduced(x: Column) -> Column:
        for pattern, out in ((r"!T", "f"), (r"!F", "T"), (r"f", "F"), (r"\(([TF])\)", "$1"), (r"T&&T", "T"), (r"[TF]&&[TF]", "F"), (r"(?<![&!])F\|\|F(?!&)", "F"), (r"(?<![&!])[TF]\|\|[TF](?!&)", "T")):
            x = F.regexp_replace(x, pattern, out)
        return x

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), flat, lambda x, _: reduced(x))
    return F.when(end == "T", True).when(end == "F", False)


def go_selected(files: DataFrame, target: tuple[str, ...] | None) -> DataFrame:
    """path, selected, error of Go files: what names and //go:build lines select for a target (system, machine, tags).
    Without a target all are selected but those whose names begin with _ or a dot. Two constraints, or one that can't be
    read, are an error."""
    base = P.basename("path")
    head = F.regexp_extract("text", r"(?s)^(.*?)(?:^|\n)\s*package\b", 1)
    lines = F.regexp_extract_all(F.regexp_replace(head, r"(?s)/\*.*?\*/", ""), F.lit(r"(?m)^//go:build[ \t]+([^\n]*)$"), F.lit(1))
    tags: tuple[str, ...] = ()
    named = F.lit(True)
    if target is not None:
        system = target[0]
        tags = tuple(dict.fromkeys([*target, *([GO_IMPLIED[system]] if system in GO_IMPLIED else []), *(["unix"] if system in GO_UNIX else []), "gc"]))
        stem = F.split(F.regexp_replace(F.regexp_replace(base, r"\.go$", ""), "_test$", ""), "_")
        last, before = F.get(stem, F.size(stem) - 1), F.get(stem, F.size(stem) - 2)
        two = (F.size(stem) > 2) & before.isin(*GO_SYSTEMS) & last.isin(*GO_MACHINES)
        known = lambda c: c.isin(*tags)
        named = F.when(two, known(before) & known(last)).when((F.size(stem) > 1) & last.isin(*GO_SYSTEMS, *GO_MACHINES), known(last)).otherwise(True)
    first = F.get(lines, F.lit(0))
    value = holds(first, tags)
    error = F.when((F.size(lines) > 1) | ((F.size(lines) == 1) & value.isNull()), "InvalidBuildConstraint")
    asked = F.lit(True) if target is None else F.coalesce(value, F.lit(True))
    return files.select("path", (~base.rlike(r"^[_.]") & named & asked & error.isNull()).alias("selected"), error.alias("error"))


def go_routed(files: DataFrame, manifests: DataFrame, target: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports of selected files with the root that they lead to, the selected files, and all modules."""
    chosen = settle(go_selected(files, target).where("selected").select("path"), "selected")
    files = files.join(chosen, "path", "left_semi")
    modules = settle(go_modules(manifests), "modules")
    roots = settle(go_roots(manifests, modules), "roots")
    owned = nearest(recover.imports(files, "go"), "src", modules.select("dir")).withColumnRenamed("dir", "owner")
    parts = F.split("name", "/")
    each = owned.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    best = Window.partitionBy(*KEY).orderBy(F.when(F.col("main") == 2, 0).otherwise(1), F.desc(F.length("prefix")), F.desc("main"))
    return each.join(roots, ["owner", "prefix"]).withColumn("_n", F.row_number().over(best)).where("_n = 1"), files, modules


def go_conflicts(files: DataFrame, manifests: DataFrame, target: tuple[str, ...] | None = None) -> DataFrame:
    """path and offset of the imports whose module the modules of a workspace replace in different ways."""
    return go_routed(files, manifests, target)[0].where("conflict").select(F.col("src").alias("path"), F.col("pos").alias("offset"))


def go_files(files: DataFrame, manifests: DataFrame, target: tuple[str, ...] | None = None) -> DataFrame:
    """Every selected file of the package that an import names: in the importer's module, in those a workspace uses
    beside it (the longest name wins), or in a directory that replaces a module."""
    routed, files, modules = go_routed(files, manifests, target)
    one = routed.where("not conflict")
    tail = F.expr("substring(name, length(prefix) + 2)")
    wanted = one.withColumn("dir", F.col("root")).withColumn("package", F.when(F.col("root") == "", tail).when(tail == "", F.col("root")).otherwise(F.concat("root", F.lit("/"), tail)))
    # files that lie in a nested module are not of this one
    there = nearest(files.select(F.col("path").alias("dst")), "dst", modules.select("dir")).select("dst", "dir", P.dirname("dst").alias("package"))
    return wanted.join(there.hint("merge"), ["dir", "package"]).select(*KEY, "name", "form", "kind", "dst")


def markdown_files(files: DataFrame) -> DataFrame:
    """Beside the document, with or without .md; wiki links also from the root, or by a name that one file has."""
    docs = files.where(F.endswith("path", F.lit(".md")))
    specs = recover.markdown_links(docs).withColumn("ord", F.lit(0))
    wiki = F.col("member") == "wiki"
    beside, root = P.joined(P.dirname("src"), F.col("name")), P.normalize("name")
    hits = ranked(specs, files, F.concat(_endings(beside, ("", ".md")), F.when(wiki, _endings(root, ("", ".md"))).otherwise(F.array().cast("array<string>"))))
    rest = specs.where("member = 'wiki'").join(hits.select("src", "pos"), ["src", "pos"], "left_anti").withColumn("base", F.regexp_replace(P.basename("name"), r"\.md$", ""))
    names = files.select("path", F.regexp_replace(P.basename("path"), r"\.md$", "").alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("dst")).where("n = 1")
    return hits.unionByName(rest.join(names.hint("merge"), "base").select(*hits.columns)).withColumn("kind", F.lit("link"))


def asset_files(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that texts hold: from the root first, then beside the text."""
    specs = recover.asset_paths(texts).withColumn("ord", F.lit(0)).withColumn("kind", F.lit("asset"))
    return ranked(specs, files, F.array(P.normalize("name"), P.joined(P.dirname("src"), F.col("name"))))
