"""Imports against declarations: packages that are imported and not declared, and declared and not imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import paths as P
from .resolve import nearest

# The ecosystem of each language, and its manifests.
ECOSYSTEMS = {"javascript": "npm", "python": "python", "rust": "cargo", "go": "go", "zig": "zig", "nim": "nim", "java": "java"}
MANIFESTS_OF = {"npm": ("package.json",), "python": ("pyproject.toml",), "cargo": ("Cargo.toml",), "go": ("go.mod",), "zig": ("build.zig.zon",), "java": ("pom.xml", "build.gradle", "build.gradle.kts"), "nim": ()}


def key_of(ecosystem: str, name: Column) -> Column:
    """Names that mean one package have one key."""
    if ecosystem == "python":
        return F.lower(F.regexp_replace(name, "[-_.]+", "-"))
    if ecosystem == "cargo":
        return F.regexp_replace(name, "-", "_")
    return F.lower(name) if ecosystem == "nim" else F.regexp_replace(name, ":.*$", "") if ecosystem == "java" else name


def prefixes(ecosystem: str, key: Column) -> Column:
    """The keys under which a package may be declared: its own, and those of paths or groups above it."""
    sep = {"go": "/", "java": "."}.get(ecosystem)
    if sep is None:
        return F.array(key)
    parts = F.split(key, r"\." if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def used(references: DataFrame, declared: DataFrame, ecosystem: str, aliases: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """src, pos, package, resolved, dir and the declaration (manifest, name: null if there is none) that governs each
    reference (src, pos, name, resolved) of the ecosystem. aliases: (imported, declared) names of one package."""
    own = declared.where(P.basename("manifest").isin(*MANIFESTS_OF[ecosystem])) if MANIFESTS_OF[ecosystem] else declared.where(F.col("manifest").rlike(r"\.nimble$"))
    at = own.select(P.dirname("manifest").alias("dir")).distinct()
    package = names.package_of(ecosystem, F.col("name"))
    refs = references.withColumn("package", package)
    for imported, name in aliases:
        refs = refs.withColumn("package", F.when(F.col("package") == imported, F.lit(name)).otherwise(F.col("package")))
    refs = refs.where("package is not null")
    refs = nearest(refs.select("src", "pos", "package", "resolved"), "src", at)
    keyed = refs.withColumn("key", F.explode(prefixes(ecosystem, key_of(ecosystem, F.col("package")))))
    there = own.select(P.dirname("manifest").alias("dir"), "manifest", F.col("name").alias("declared"), key_of(ecosystem, F.col("name")).alias("key"))
    hits = keyed.join(there.hint("merge"), ["dir", "key"], "left")
    longest = F.max(F.when(F.col("declared").isNotNull(), F.length("key"))).over(Window.partitionBy("src", "pos", "package"))
    return hits.withColumn("_l", longest).where(F.col("_l").isNull() | (F.col("declared").isNotNull() & ((F.length("key") == F.col("_l")) | (F.lit(ecosystem) != "go")))).select("src", "pos", "package", "resolved", "dir", "manifest", "declared").distinct()


def undeclared(uses: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """src, package, pos: once a file and package, at its first reference that resolves to no file."""
    rows = uses.where(F.col("declared").isNull() & ~F.col("resolved") & ~F.col("package").isin(*ignore))
    return rows.groupBy("src", "package").agg(F.min("pos").alias("pos"))


def unused(uses: DataFrame, declared: DataFrame, ecosystem: str, scopes: tuple[str, ...] = ("runtime",), ignore: tuple[str, ...] = ()) -> DataFrame:
    """manifest, name of declarations in these scopes that no file which they govern imports."""
    own = declared.where(P.basename("manifest").isin(*MANIFESTS_OF[ecosystem])) if MANIFESTS_OF[ecosystem] else declared.where(F.col("manifest").rlike(r"\.nimble$"))
    own = own.where(names.dependency_scope(F.col("manifest"), F.col("grp")).isin(*scopes) & ~F.col("name").isin(*ignore) & (F.col("grp") != "indirect"))
    hit = uses.where("declared is not null").select("manifest", F.col("declared").alias("name"))
    return own.join(hit.hint("merge"), ["manifest", "name"], "left_anti").select("manifest", "name").distinct()
