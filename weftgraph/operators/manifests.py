"""Declared dependencies of package manifests, read on the JVM.

Rows: manifest, name, requirement, source, grp (the table that holds the declaration), origin (registry, local,
remote or workspace). Only literal declarations are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import paths as P
from . import gradle as gradle_scripts

COLUMNS = ("manifest", "name", "requirement", "source", "grp", "origin")
# Groups of package.json.
NPM_GROUPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def _of(files: DataFrame, *base: str) -> DataFrame:
    return files.where(P.basename("path").isin(*base)).select(F.col("path").alias("manifest"), F.col("text"))


def _out(df: DataFrame, **c: Column) -> DataFrame:
    given = {"requirement": F.lit(""), "source": F.lit(""), "origin": F.lit("registry")} | c
    return df.select(*(F.coalesce(given.get(x, F.col(x) if x in df.columns else F.lit("")), F.lit("")).alias(x) for x in COLUMNS))


def npm_origin(r: Column) -> Column:
    return (
        F.when(F.startswith(r, F.lit("workspace:")), "workspace")
        .when(F.startswith(r, F.lit("npm:")), "registry")
        .when(r.rlike(r"^(file:|link:|\./|\.\./|/|~/)"), "local")
        .when(r.rlike("^git|:|/"), "remote")
        .otherwise("registry")
    )


def package_json(files: DataFrame) -> DataFrame:
    rows = _of(files, "package.json")
    shape = ", ".join(f"{g} map<string,string>" for g in NPM_GROUPS)
    parsed = rows.withColumn("j", F.from_json("text", shape))
    each = [parsed.select("manifest", F.lit(g).alias("grp"), F.explode(f"j.{g}").alias("name", "requirement")) for g in NPM_GROUPS]
    r = F.col("requirement")
    source = F.when(r.contains("/") | r.rlike("^(git|file:|github:|workspace:)"), r).otherwise("")
    return _out(reduce(DataFrame.unionByName, each), requirement=r, source=source, origin=npm_origin(r))


def _lines(rows: DataFrame, body: Column) -> DataFrame:
    return rows.withColumn("line", F.explode(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")))


def go_mod(files: DataFrame) -> DataFrame:
    rows = _of(files, "go.mod")
    blocks = F.regexp_extract_all("text", F.lit(r"(?ms)^\s*require\s*\((.*?)^\s*\)"), F.lit(1))
    single = F.regexp_extract_all("text", F.lit(r"(?m)^\s*require\s+([^\s(][^\n]*)$"), F.lit(1))
    lines = _lines(rows, F.array_join(F.concat(blocks, single), "\n")).where(~F.startswith("line", F.lit("//")))
    name = F.regexp_extract("line", r'^"?([^\s"]+)', 1)
    return _out(lines, name=name, requirement=F.regexp_extract("line", r"^\S+\s+(\S+)", 1), source=name, grp=F.when(F.col("line").rlike(r"//\s*indirect"), "indirect").otherwise("require"), origin=F.lit("remote"))


def _sections(rows: DataFrame) -> DataFrame:
    """manifest, section and body of each table of a TOML text."""
    whole = F.regexp_extract_all("text", F.lit(r"(?ms)^[ \t]*\[([^\[\]\n]+)\][ \t]*(?:#[^\n]*)?$(.*?)(?=^[ \t]*\[|\z)"), F.lit(0))
    cut = rows.select("manifest", F.explode(whole).alias("s"))
    return cut.select("manifest", F.regexp_extract("s", r"^\s*\[([^\]]+)\]", 1).alias("section"), F.regexp_replace("s", r"^\s*\[[^\n]*", "").alias("body"))


def _entry(value: Column) -> dict[str, Column]:
    key = lambda k: F.regexp_extract(value, rf'\b{k}\s*=\s*"([^"]*)"', 1)
    table, plain = F.startswith(value, F.lit("{")), F.regexp_extract(value, r'^"([^"]*)"', 1)
    source = F.when(table, F.when(key("git") != "", key("git")).when(key("path") != "", key("path")).otherwise(key("url"))).otherwise("")
    origin = F.when(table & value.rlike(r"\bworkspace\s*=\s*true"), "workspace").when(table & (key("path") != ""), "local").when(source != "", "remote").otherwise("registry")
    return {"requirement": F.when(table, key("version")).otherwise(plain), "source": source, "origin": origin}


def cargo_toml(files: DataFrame) -> DataFrame:
    tables = _sections(_of(files, "Cargo.toml"))
    kind = r"^(?:target\..+\.)?(?:dev-|build-)?dependencies"
    lines = _lines(tables.where(F.col("section").rlike(kind + "$")), F.col("body")).where(~F.startswith("line", F.lit("#")))
    inline = _out(lines, name=F.regexp_replace(F.regexp_extract("line", r"^([^=\s.]+)", 1), '"', ""), grp=F.col("section"), **_entry(F.trim(F.regexp_extract("line", r"^[^=]+=(.*)$", 1))))
    own = tables.where(F.col("section").rlike(kind + r"\.[^.]+$")).withColumn("v", F.concat(F.lit("{"), F.regexp_replace("body", r"\n", ","), F.lit("}")))
    return inline.unionByName(_out(own, name=F.regexp_extract("section", r"([^.]+)$", 1), grp=F.regexp_replace("section", r"\.[^.]+$", ""), **_entry(F.col("v"))))


def _requirements(rows: DataFrame, listed: Column, grp: Column) -> DataFrame:
    """PEP 508 strings."""
    each = rows.select("manifest", grp.alias("grp"), F.explode(F.regexp_extract_all(listed, F.lit(r"""["']([^"'\n]+)["']"""), F.lit(1))).alias("r"))
    name = F.regexp_extract("r", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    source = F.trim(F.regexp_extract("r", r"@\s*([^;]+)", 1))
    rest = F.trim(F.regexp_replace(F.regexp_replace("r", r"^\s*[A-Za-z0-9._-]+\s*(\[[^\]]*\])?", ""), r"@.*$", ""))
    return _out(each, name=name, requirement=rest, source=source, origin=F.when(source == "", "registry").otherwise("remote"))


def pyproject_toml(files: DataFrame) -> DataFrame:
    # strings in arrays may hold brackets, so sections end at a bracket that begins a line and no array item
    tables = _sections(_of(files, "pyproject.toml"))
    array = r"(?ms)^\s*%s\s*=\s*\[(.*?)\]\s*(?:#[^\n]*)?$"
    main = _requirements(tables.where("section = 'project'"), F.regexp_extract("body", array % "dependencies", 1), F.lit("project.dependencies"))

    def named(section: str) -> DataFrame:
        arrays = F.regexp_extract_all("body", F.lit(array % r"[\w.-]+"), F.lit(0))
        rows = tables.where(F.col("section") == section).select("manifest", F.explode(arrays).alias("a"))
        return _requirements(rows, F.regexp_replace("a", r"^\s*[\w.-]+\s*=", ""), F.concat(F.lit(f"{section}."), F.regexp_extract("a", r"^\s*([\w.-]+)", 1)))

    poetry = _lines(tables.where(F.col("section").rlike(r"^tool\.poetry\.(group\.[^.]+\.)?(dev-)?dependencies$")), F.col("body")).where(~F.startswith("line", F.lit("#")))
    old = _out(poetry, name=F.regexp_replace(F.regexp_extract("line", r"^([^=\s]+)", 1), '"', ""), grp=F.col("section"), **_entry(F.trim(F.regexp_extract("line", r"^[^=]+=(.*)$", 1))))
    return main.unionByName(named("project.optional-dependencies")).unionByName(named("dependency-groups")).unionByName(old.where("name <> 'python'"))


def pom_xml(files: DataFrame) -> DataFrame:
    """Of project/dependencies only; ${...} is taken from the properties of the same file."""
    rows = _of(files, "pom.xml").withColumn("t", F.regexp_replace("text", r"(?s)<!--.*?-->|<dependencyManagement>.*?</dependencyManagement>|<build>.*?</build>|<profiles>.*?</profiles>", ""))
    props = F.regexp_extract_all(F.regexp_extract("t", r"(?s)<properties>(.*?)</properties>", 1), F.lit(r"<([\w.-]+)>([^<]*)</\1>"), F.lit(0))
    each = rows.select("manifest", props.alias("props"), F.explode(F.regexp_extract_all("t", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    filled = F.aggregate("props", F.col("d"), lambda d, p: F.replace(d, F.concat(F.lit("${"), F.regexp_extract(p, r"^<([\w.-]+)>", 1), F.lit("}")), F.regexp_extract(p, r">([^<]*)<", 1)))
    each = each.withColumn("d", filled)
    tag = lambda t: F.trim(F.regexp_extract("d", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1))
    scope = F.when(tag("scope") == "", "compile").otherwise(tag("scope"))
    return _out(each, name=F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), requirement=tag("version"), grp=F.when(tag("optional") == "true", F.concat(scope, F.lit(",optional"))).otherwise(scope), source=tag("systemPath"), origin=F.when(tag("systemPath") == "", "registry").otherwise("local")).where("name not like '%${%'")


def gradle(files: DataFrame) -> DataFrame:
    """Literal notations: strings, maps, projects and platforms; computed ones are gradle_scripts.unsupported()."""
    rows = gradle_scripts.read(files).where("grp is not null")
    first = F.regexp_extract("said", "^([^:]+:[^:]+)", 1)
    name = F.when(F.col("project"), F.col("said")).otherwise(first)
    requirement = F.when(F.col("project"), "").otherwise(F.regexp_extract("said", "^[^:]+:[^:]+:(.*)$", 1))
    return _out(rows, name=name, requirement=requirement, origin=F.when(F.col("project"), "workspace").otherwise("registry"))


def nimble(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("path").rlike(r"[^/]\.nimble$")).select(F.col("path").alias("manifest"), F.regexp_replace("text", "(?m)#(?![^\"\\n]*\"[^\"\\n]*$)[^\\n]*$", "").alias("t"))
    said = rows.select("manifest", F.explode(F.regexp_extract_all("t", F.lit(r'(?m)^\s*(requires|taskRequires)[ (]+("[^"\n]*"(?:\s*,\s*"[^"\n]*")*)'), F.lit(0))).alias("s"))
    task = F.startswith(F.trim("s"), F.lit("taskRequires"))
    quoted = F.regexp_extract_all("s", F.lit(r'"([^"]*)"'), F.lit(1))
    each = said.select("manifest", F.when(task, F.concat(F.lit("taskRequires."), quoted[0])).otherwise("requires").alias("grp"), F.explode(F.when(task, F.slice(quoted, F.lit(2), F.size(quoted))).otherwise(quoted)).alias("r"))
    name = F.regexp_extract("r", r"^\s*([^\s<>=~^#@]+)", 1)
    return _out(each, name=name, requirement=F.trim(F.regexp_replace("r", r"^\s*[^\s<>=~^#@]+", "")), source=F.when(name.contains("/"), name).otherwise(""), origin=F.when(name.contains("/"), "remote").otherwise("registry")).where("name <> 'nim'")


def zig_zon(files: DataFrame) -> DataFrame:
    rows = _of(files, "build.zig.zon").withColumn("t", F.regexp_replace("text", r"(?m)(?<!:)//[^\n]*$", ""))
    body = F.regexp_extract("t", r"(?s)\.dependencies\s*=\s*\.\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    each = rows.select("manifest", F.explode(F.regexp_extract_all(body, F.lit(r'(?s)\.(?:@")?([\w-]+)"?\s*=\s*\.\{[^{}]*\}'), F.lit(0))).alias("s"))
    key = lambda k: F.regexp_extract("s", rf'\.{k}\s*=\s*"([^"]*)"', 1)
    return _out(each, name=F.regexp_extract("s", r'^\.(?:@")?([\w-]+)', 1), requirement=key("hash"), source=F.when(key("url") != "", key("url")).otherwise(key("path")), grp=F.lit("dependencies"), origin=F.when(key("url") != "", "remote").otherwise("local"))


READERS = (package_json, zig_zon, go_mod, cargo_toml, pyproject_toml, pom_xml, gradle, nimble)


def declared(files: DataFrame) -> DataFrame:
    """All declarations of the manifests among files (path, text)."""
    own = files.where(names.is_manifest(F.col("path")))
    return reduce(DataFrame.unionByName, (read(own) for read in READERS))


def _deep(value: str, level: str, depth: int = 6) -> str:
    out = value
    for _ in range(depth):
        out = level.replace("@", out)
    return out


# The grammar of TOML, values of arrays and tables nested six levels deep.
_GAP, _NOTE = r"[ \t]*+", r"#[^\n]*+"
_END = rf"{_GAP}(?:{_NOTE})?+\r?(?:\n|\z)"
_LINES = rf"(?:[ \t\r\n]|{_NOTE}(?:\n|\z))*+"
_BASIC, _PLAIN = r'"(?:[^"\\\n]|\\[^\n])*+"', r"'[^'\n]*+'"
_LONG = r'"{3}(?:[^"\\]|\\(?s:.)|"{1,2}(?!"))*+"{3,5}'
_KEY = rf"(?:[A-Za-z0-9_-]++|{_BASIC}|{_PLAIN})"
_KEYS = rf"{_KEY}(?:{_GAP}\.{_GAP}{_KEY})*+"
_SCALAR = rf"{_LONG}|'{{3}}(?s:.*?)'{{3,5}}|{_BASIC}|{_PLAIN}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9][0-9:.Z+-]*+|[A-Za-z0-9+_.:-]++"
_ARRAY, _TABLE = rf"\[{_LINES}(?:@{_LINES}(?:,{_LINES}|(?=\])))*+\]", rf"\{{{_GAP}(?:{_KEYS}{_GAP}={_GAP}@{_GAP}(?:,{_GAP}|(?=\}})))*+\}}"
_VALUE = _deep(f"(?:{_SCALAR})", f"(?:{_SCALAR}|{_ARRAY}|{_TABLE})")
TOML = rf"\A(?:{_GAP}(?:\[\[{_GAP}{_KEYS}{_GAP}\]\]|\[{_GAP}{_KEYS}{_GAP}\]|{_KEYS}{_GAP}={_GAP}{_VALUE})?+{_END})*+"


def invalid(files: DataFrame) -> DataFrame:
    """path, cause and offset of manifests that their grammar doesn't take: of TOML the byte where the first line begins
    that no statement takes; of JSON null."""
    toml = files.where(P.basename("path").isin("Cargo.toml", "pyproject.toml") & F.col("text").isNotNull())
    good = F.octet_length(F.regexp_extract("text", TOML, 0))
    torn = toml.select("path", good.cast("long").alias("offset"), F.octet_length("text").alias("size")).where("offset < size")
    json = files.where((P.basename("path") == "package.json") & F.col("text").isNotNull() & F.try_parse_json("text").isNull())
    cause = F.lit("InvalidManifest").alias("cause")
    return torn.select("path", cause, "offset").unionByName(json.select("path", cause, F.lit(None).cast("long").alias("offset")))
