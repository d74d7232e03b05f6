"""Links of Markdown: inline links, wiki links, and references by way of definitions.

Blocks come first: tiles over a text's lines say where a definition may stand, as CommonMark has it: where a paragraph
could begin, in no fence, indented by three spaces at most. Definitions are then blanked out and what is left is scanned
for links, comments, code spans and fences passed over. A reference counts where its label is defined: labels are folded,
of equal ones the first definition holds, and the two meet in a join. A reference that lies in another that counts is
part of its text. Patterns are possessive; brackets are followed NESTED levels deep, parentheses 32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NESTED = 16
#: Bytes of a label at most.
MOST_LABEL = 999


def _nested(level: str, depth: int, base: str = "(?!)") -> str:
    out = base
    for _ in range(depth):
        out = level.replace("@", out)
    return out


# The grammar of definitions and links.
_BLANK = r"[ \t\r]*+(?:\n|\z)"
_ESCAPE = r"\\(?s:.)"
_INSIDE = rf"[^\[\]\\\n]|{_ESCAPE}|\n(?!{_BLANK})"
_LABEL = rf"(?!\s*+\])(?:{_INSIDE}){{1,{MOST_LABEL}}}+"
_PLAIN = rf"[^\x00-\x20\x7f()\\]|{_ESCAPE}"
_RUN = rf"(?!<)(?:{_PLAIN}|{_nested(rf'[(](?:{_PLAIN}|@)*+[)]', 32)})++"
_TITLE = rf"""(?:"(?:[^"\\\n]|{_ESCAPE}|\n(?!{_BLANK}))*+"|'(?:[^'\\\n]|{_ESCAPE}|\n(?!{_BLANK}))*+'|\((?:[^()\\\n]|{_ESCAPE}|\n(?!{_BLANK}))*+\)){_BLANK}"""
DEFINITION = rf"^ {{0,3}}\[({_LABEL})\]:[ \t\r]*+(?:\n[ \t\r]*+)?+(?:<((?:[^<>\\\n]|\\[^\n])*+)>|({_RUN}))(?:[ \t]*+(?:\r?\n|\z)(?:[ \t]*+{_TITLE})?+|[ \t]++{_TITLE})"
_FENCE = r"^ {0,3}(?:(`{3,}+)[^\n]*+(?s:.*?)(?:^ {0,3}@1`*+[ \t\r]*+$|\z)|(~{3,}+)[^\n]*+(?s:.*?)(?:^ {0,3}@2~*+[ \t\r]*+$|\z))"
_LINE = r"(?!^[ \t\r]*+$)(?!^ {0,3}(?:`{3}|~{3}|#))[^\n]++\n?"
BLOCK = rf"(?m){DEFINITION}|{_FENCE.replace('@1', chr(92) + '4').replace('@2', chr(92) + '5')}|^[ \t\r]*+\n|^ {{0,3}}[ \t][^\n]*+\n?|^ {{0,3}}#[^\n]*+\n?|^[^\n]++\n?(?:{_LINE})*+|(?s:.)"
_TEXT = rf"(?:{_INSIDE}|{_nested(rf'[\[](?:{_INSIDE}|@)*+[\]]', NESTED)}){{1,{MOST_LABEL}}}+"
_WIKI = r"\[\[(?:[^\[\]\n]|\](?!\])|\[(?!\[))*+\]\]"
_REFERENCE = rf"\[(?!\[)(?=({_TEXT})\](?:\[({_LABEL})\]|(\[\])|(?![(\[])))"
_PARENS = _nested(rf"[(](?:[^()\\]|{_ESCAPE}|@)*+[)]", NESTED)
_INLINE = rf"\]\(\s*+(?:<(?:[^>\\]|{_ESCAPE})*+|(?:[^\s()\\]|{_ESCAPE}|{_PARENS})++)"
_SKIPPED = r"^ {0,3}(`{3,}+|~{3,}+)(?s:.*?)(?:^ {0,3}\5[`~]*+[^\n]*+$|\z)|<!--(?s:.*?)(?:-->|\z)|(?<!`)(`++)(?!`)(?s:.*?)(?<!`)\6(?!`)|`++|\\(?s:.)|\[\["
_TILE = rf"(?m)(?s:.*?)(?:({_WIKI}|{_REFERENCE}|{_INLINE})|{_SKIPPED}|\z)"


def folded(label: Column) -> Column:
    """A label as labels match: trimmed, white space one space, letters without their case. The dotless i stays apart."""
    plain = F.regexp_replace(F.regexp_replace(label, r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"[ \t\n\r]+", " ")
    # the mark keeps Spark from taking the conversions for one: together they fold what has two capitals or none
    lower = F.concat(F.lower(F.concat(F.upper(F.replace(plain, F.lit("ı"), F.lit("\ue000"))), F.lit("."))), F.lit("."))
    return F.upper(lower)


def blocks(files: DataFrame) -> DataFrame:
    """path, tiles (of the text, in order) and pos, label and destination of its definitions. files: path and text."""
    tiles = F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0))
    own = files.where(F.col("text").contains("]:")).select(F.col("path").alias("src"), F.posexplode(tiles).alias("n", "tile"))
    return own.where(F.startswith(F.ltrim("tile"), F.lit("[")) & F.col("tile").rlike(rf"(?m)\A{DEFINITION}\z"))


def definitions(files: DataFrame) -> DataFrame:
    """src, key and destination: the first definition of each label."""
    part = lambda k: F.regexp_extract("tile", rf"(?m)\A{DEFINITION}\z", k)
    rows = blocks(files).select("src", "n", folded(part(1)).alias("key"), F.concat(part(2), part(3)).alias("destination"))
    return rows.groupBy("src", "key").agg(F.min_by("destination", "n").alias("destination"))


def without_definitions(text: Column) -> Column:
    """The text with spaces in the place of definitions, byte for byte."""
    blank = lambda t: F.concat(F.repeat(F.lit(" "), F.octet_length(t) - 1), F.lit("\n"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda t: F.when(F.startswith(F.ltrim(t), F.lit("[")) & t.rlike(rf"(?m)\A{DEFINITION}\z"), blank(t)).otherwise(t))
    return F.when(text.contains("]:"), F.array_join(kept, "")).otherwise(text)


def _found(files: DataFrame) -> DataFrame:
    """src, pos (byte offset), s, said (text of a reference), label of what may be a link."""
    rows = files.select(F.col("path").alias("src"), without_definitions(F.col("text")).alias("text"))
    part = lambda k, name: F.regexp_extract_all("text", F.lit(_TILE), F.lit(k)).alias(name)
    both = F.arrays_zip(part(0, "tile"), part(1, "s"), part(2, "said"), part(3, "label"))
    each = rows.select("src", F.posexplode(both).alias("n", "x")).select("src", "n", F.octet_length("x.tile").alias("size"), "x.s", "x.said", "x.label")
    # tiles cover a text, so their sizes add up to where one ends; a text is one value, and so are its tiles
    ends = F.sum("size").over(Window.partitionBy("src").orderBy("n"))
    return each.withColumn("pos", ends - F.octet_length("s")).where("s <> ''").select("src", "pos", "s", "said", "label")


def destination(raw: Column) -> Column:
    """A destination as a file of the project: null for what has a scheme, is absolute or is a fragment only."""
    name = F.regexp_replace(raw, "(?s)#.*$", "")
    return F.when((name != "") & ~name.contains(":") & ~F.startswith(name, F.lit("/")), F.regexp_replace(name, r"\\(\p{Punct})", "$1"))


def links(files: DataFrame) -> DataFrame:
    """src, pos (byte offset), name, member ("wiki" or null) of the links to other files."""
    found = _found(files)
    s = F.col("s")
    plain = found.where(s != "[")
    wiki = F.startswith(s, F.lit("[["))
    inline = F.regexp_replace(s, r"(?s)^\]\(\s*<?", "")
    name = F.when(wiki, F.trim(F.regexp_extract("s", r"^\[\[([^|#\]]*)", 1))).otherwise(destination(inline))
    direct = plain.select("src", "pos", (F.col("pos") + F.octet_length("s")).alias("end"), F.when(name != "", name).alias("name"), F.when(wiki, "wiki").alias("member"))
    told = found.where((s == "[") & (F.octet_length("said") <= MOST_LABEL))
    length = 2 + F.octet_length("said") + F.when(F.col("label") != "", F.octet_length("label") + 2).otherwise(0)
    named = told.select("src", "pos", (F.col("pos") + length).alias("end"), folded(F.when(F.col("label") != "", F.col("label")).otherwise(F.col("said"))).alias("key"))
    referred = named.join(definitions(files).hint("merge"), ["src", "key"]).select("src", "pos", "end", destination(F.col("destination")).alias("name"), F.lit(None).cast("string").alias("member"))
    every = direct.unionByName(referred).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "end", "name", "member"))).alias("all"))
    # from left to right: what begins in a link that counts is no link of its own
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("kept"))
    pick = lambda a, x, i: F.when(x["pos"] >= a["end"], F.struct(x["end"].alias("end"), F.concat(a["kept"], i.cast("string"), F.lit(",")).alias("kept"))).otherwise(a)
    kept = F.aggregate(F.sequence(F.lit(0), F.size("all") - 1), start, lambda a, i: pick(a, F.get("all", i), i), lambda a: a["kept"])
    rows = every.select("src", "all", F.explode(F.split(kept, ",")).alias("i")).where("i <> ''").select("src", F.inline(F.array(F.get("all", F.col("i").cast("int")))))
    return rows.where("name is not null").select("src", "pos", "name", "member")
