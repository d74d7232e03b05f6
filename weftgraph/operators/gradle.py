"""Statements of the dependencies blocks of Gradle's scripts, Groovy and Kotlin, read lexically on the JVM.

A script is cut into pieces; one aggregation passes over them with two stacks as its state. The first holds what the
place lies in: strings, the code inside their ${...}, braces of that code, comments; nested as deep as a script nests.
The second holds blocks; a count says how many brackets a statement has open. A statement of a dependencies block is kept as its
words, strings and marks; what it declares is then a matter of patterns over them. Nothing is evaluated: what is computed
declares nothing and is named as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# Pieces that the scan knows, and blocks within dependencies that declare nothing.
PIECES = r"""\\(?s:.)|\"{3}|'{3}|["'`]|\$\{|\$(?=[A-Za-z_])|//|/\*|\*/|\n|[{}()\[\],;:=.]|[\w\x{80}-\x{10FFFF}]++|[ \t\r\f]++|(?s:.)"""
SILENT = ("constraints", "components", "modules", "attributesSchema", "artifactTypes", "registerTransform")
#: What parts the tokens of a statement.
GAP = "\u0001"


def statements(text: Column, kotlin: Column) -> Column:
    """pos (byte offset) and s (tokens, each with a GAP after it) of the statements of a script's dependencies blocks.

    Tokens: w and a word, s and a string, t (a string with code in it), p and a mark, o (anything else)."""
    # what was found is one text in the state, as arrays would be built anew element by element
    found = lambda pos, s: F.concat(pos.cast("string"), F.lit("\u0002"), s, F.lit("\u0003"))
    none = F.lit("")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("within"), none.alias("said"), F.lit(0).cast("long").alias("opened"), F.lit(False).alias("code"), none.alias("blocks"), F.lit(0).alias("depth"), none.alias("before"), none.alias("last"), none.alias("cur"), F.lit(0).cast("long").alias("start"), none.alias("out"))

    def moved(a: Column, x: Column) -> Column:
        """What the place after this piece lies in."""
        within, top = a["within"], lambda c: F.endswith(a["within"], F.lit(c))
        up, push = F.left(within, F.octet_length(within) - 1), lambda c: F.concat(within, F.lit(c))
        ends_line = (x == "\n") & (F.octet_length(within) == 1)
        opens = F.when(x == '"', push("s")).when(x == '"""', push("T")).when((x == "'''") & ~kotlin, push("R")).when(x.isin("'", "'''"), push("q"))
        return (
            F.when(within == "", F.when(x == "//", push("l")).when(x == "/*", push("k")).when((x == "`") & kotlin, push("b")).otherwise(F.coalesce(opens, within)))
            .when(top("s"), F.when(x.isin('"', '"""') | ends_line, up).when(x == "${", push("c")).otherwise(within))
            .when(top("q"), F.when(x.isin("'", "'''") | ends_line, up).otherwise(within))
            .when(top("b"), F.when((x == "`") | (x == "\n"), up).otherwise(within))
            .when(top("T"), F.when(x == '"""', up).otherwise(within))
            .when(top("R"), F.when(x == "'''", up).otherwise(within))
            .when(top("l"), F.when(x == "\n", up).otherwise(within))
            .when(top("k"), F.when(x == "*/", up).when((x == "/*") & kotlin, push("k")).otherwise(within))
            .otherwise(F.when(x.isin("{", "${"), push("c")).when(x == "}", up).otherwise(F.coalesce(opens, within)))
        )

    def lexed(a: Column, x: Column, after: Column) -> Column:
        """The state of the text, and the token that ends with this piece (null if none does)."""
        within = a["within"]
        closed = (within.isin("s", "q") & (after == "") & (x != "\n")) | ((within == "b") & (x == "`"))
        code = F.when(within == "", False).otherwise(a["code"] | (F.endswith(within, F.lit("s")) & (x.isin("${", "$"))))
        string = F.when(within == "b", F.concat(F.lit("w"), a["said"])).when(code, "t").when(~((within == "q") & kotlin), F.concat(F.lit("s"), a["said"]))
        plain = F.when(x == "\n", "n").when(x.rlike(r"^[{}()\[\],;:=.]$"), F.concat(F.lit("p"), x)).when(x.rlike(r"^[\w\x{80}-\x{10FFFF}]"), F.concat(F.lit("w"), x)).when(~x.rlike(r"^[ \t\r\f]"), "o")
        token = F.when(closed, string).when((after == "") & (x == "\n"), "n").when((within == "") & (after == ""), plain)
        said = F.when((within == "") | (after == ""), "").otherwise(F.concat(a["said"], x))
        opened = F.when(within == "", a["at"]).otherwise(a["opened"])
        return F.struct(after.alias("within"), said.alias("said"), opened.alias("opened"), code.alias("code"), token.alias("token"))

    def parsed(a: Column, x: Column, y: Column) -> Column:
        """The state after a piece: what y says of the text, and what its token does to blocks and statements."""
        t, blocks, cur = y["token"], a["blocks"], a["cur"]
        inside, depth = F.endswith(blocks, F.lit("D")), a["depth"] > 0
        up = F.left(blocks, F.greatest(F.octet_length(blocks) - 1, F.lit(0)))
        opening, closing = t.isin("p{", "p(", "p["), t.isin("p}", "p)", "p]")
        ends = inside & ~depth & ((t == "p}") | t.isin("p)", "p]", "p;") | ((t == "n") & (a["last"] != "p,")))
        stray = inside & ~depth & t.isin("p)", "p]")
        grown = F.when(~inside | (t == "n"), cur).otherwise(F.concat(cur, t, F.lit(GAP)))
        now = (
            F.when(~inside, F.when(t == "p{", F.concat(blocks, F.when((a["last"] == "wdependencies") & (a["before"] != "p."), F.lit("D")).otherwise("B"))).when(t == "p}", up).otherwise(blocks))
            .when(~depth & (t == "p}"), up)
            .otherwise(blocks)
        )
        deeper = a["depth"] + F.when(~inside, 0).when(opening, 1).when(depth & closing, -1).otherwise(0)
        one = F.when(ends & (cur != ""), found(a["start"], cur)).otherwise("")
        two = F.when(stray, found(y["opened"], F.concat(t, F.lit(GAP)))).otherwise("")
        said = t.isNotNull()
        return F.struct(
            (a["at"] + F.octet_length(x)).alias("at"), y["within"].alias("within"), y["said"].alias("said"), y["opened"].alias("opened"), y["code"].alias("code"),
            F.when(said, now).otherwise(blocks).alias("blocks"), F.when(said, deeper).otherwise(a["depth"]).alias("depth"), F.when(said, a["last"]).otherwise(a["before"]).alias("before"), F.coalesce(t, a["last"]).alias("last"),
            F.when(~said, cur).when(ends, "").otherwise(grown).alias("cur"), F.when(cur == "", y["opened"]).otherwise(a["start"]).alias("start"),
            F.when(said & (ends & (cur != "") | stray), F.concat(a["out"], one, two)).otherwise(a["out"]).alias("out"),
        )

    # the parts of a step are bound as elements, so that the next part does not write them out anew; the state is that
    # of an aggregation, so that what was found is handed on and not copied
    def step(a: Column, x: Column) -> Column:
        full = F.aggregate(F.array(moved(a, x)), a, lambda b, w: F.aggregate(F.array(lexed(b, x, w)), b, lambda c, y: parsed(c, x, y)))
        return F.when((a["within"] == "") & F.trim(x).isin("", "\r"), a.withField("at", a["at"] + F.octet_length(x))).otherwise(full)

    last = lambda a: F.when((a["cur"] != "") & F.endswith(a["blocks"], F.lit("D")), F.concat(a["out"], found(a["start"], a["cur"]))).otherwise(a["out"])
    each = F.split(F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), start, step, last), "\u0003")
    return F.transform(F.filter(each, lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "\u0002", 1).cast("long").alias("pos"), F.substring_index(x, "\u0002", -1).alias("s")))


# patterns over the tokens of a statement
_STRING = rf"s[^{GAP}]*{GAP}"
_COORDINATES = rf"s[^:{GAP}]+:[^:{GAP}]+(?::[^{GAP}]*)?{GAP}"
_PROJECT = rf"wproject{GAP}p\({GAP}(?:wpath{GAP}p[:=]{GAP})?{_STRING}p\){GAP}"
_NOTATION = rf"(?:{_COORDINATES}|w(?:platform|enforcedPlatform){GAP}p\({GAP}{_COORDINATES}p\){GAP}|{_PROJECT})"
_PAIR = rf"w[^{GAP}]+{GAP}p[:=]{GAP}(?:{_STRING}|w(?:true|false){GAP})"
_ARGUMENTS = rf"(?:{_PAIR}(?:p,{GAP}{_PAIR})*|{_NOTATION}(?:p,{GAP}{_NOTATION})*)"
_CLOSURE = rf"(?:p\{{{GAP}.*)?"
_ADD = rf"wadd{GAP}p\({GAP}s([^{GAP}]*){GAP}p,{GAP}({_NOTATION})p\){GAP}{_CLOSURE}"
_CALL = rf"[ws]([^{GAP}]+){GAP}(?:p\({GAP}({_ARGUMENTS})p\){GAP}|({_ARGUMENTS})){_CLOSURE}"


def read(files: DataFrame) -> DataFrame:
    """manifest, pos, grp, said (a notation's string, or a map's pairs), project, of every declaration; and a row with a null
    grp for each statement that is computed. files: path and text."""
    own = files.where(P.basename("path").isin("build.gradle", "build.gradle.kts"))
    bare = F.regexp_replace("text", r"^#![^\n]*", "")
    shift = F.octet_length("text") - F.octet_length(bare)
    said = own.select(F.col("path").alias("manifest"), shift.alias("shift"), F.explode(statements(bare, F.endswith("path", F.lit(".kts")))).alias("x"))
    said = said.select("manifest", (F.col("shift") + F.col("x.pos")).alias("pos"), F.col("x.s").alias("s"))
    said = said.where(~F.col("s").rlike(rf"^w(?:{'|'.join(SILENT)}){GAP}p\{{{GAP}"))
    part = lambda pattern, k: F.regexp_extract("s", rf"(?s)^{pattern}$", k)
    added = part(_ADD, 2) != ""
    arguments = F.when(added, part(_ADD, 2)).otherwise(F.concat(part(_CALL, 2), part(_CALL, 3)))
    parts = said.select("manifest", "pos", F.when(added, part(_ADD, 1)).otherwise(part(_CALL, 1)).alias("grp"), arguments.alias("args"))
    pair = lambda k: F.regexp_extract("args", rf"(?:^|p,{GAP})w{k}{GAP}p[:=]{GAP}s([^{GAP}]*){GAP}", 1)
    mapped = F.col("args").rlike(rf"^{_PAIR}")
    whole = F.when((pair("group") != "") & (pair("name") != ""), F.array(F.concat_ws(":", pair("group"), pair("name"), F.when(pair("version") != "", pair("version"))))).otherwise(F.array().cast("array<string>"))
    each = F.when(mapped, whole).otherwise(F.regexp_extract_all("args", F.lit(_NOTATION), F.lit(0)))
    rows = parts.select("manifest", "pos", "grp", F.explode_outer(each).alias("n"))
    project = F.startswith(F.col("n"), F.lit("wproject"))
    value = F.when(F.col("n").contains(GAP), F.regexp_extract("n", rf"s([^{GAP}]*){GAP}(?:p\){GAP})?$", 1)).otherwise(F.col("n"))
    return rows.select("manifest", "pos", F.when(F.col("n").isNotNull(), F.col("grp")).alias("grp"), value.alias("said"), F.coalesce(project, F.lit(False)).alias("project"))


def unsupported(files: DataFrame) -> DataFrame:
    """path, offset, expression of the statements that are computed."""
    return read(files).where("grp is null").select(F.col("manifest").alias("path"), F.col("pos").alias("offset"), F.lit("gradle_dependency").alias("expression"))
