"""References that texts hold, recovered by one scan of each text on the JVM.

For each language one alternation is matched from left to right: what must not be read (comments, strings, regular
expressions) and the statements that name other files. A match of the former is passed over, so a statement within it
is never seen; no text leaves the JVM. Matches tile the text, so the bytes before a statement are its offset. What can
hold statements of its own (a TYPE_CHECKING block, a module in braces, a template with expressions) is matched whole
and scanned again. Repetitions in the patterns are possessive, so hostile texts take linear time and no stack. Nesting
of comments, braces and templates is followed NESTED levels deep; deeper ones end at the first close.

Rows of imports(): src, pos (the byte offset of the statement), ord (of a name within it), name, form, kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from . import markdown
from .paths import bound

NESTED = 6


def _nested(base: str, level: str, depth: int = NESTED) -> str:
    """A pattern that may hold itself: level with @ for the pattern one level down."""
    out = base
    for _ in range(depth):
        out = level.replace("@", out)
    return out


# Pieces of the languages' lexical grammar. A quote that is never closed ends at its line.
_END = r"(?=\n)|\z"
_DQ, _SQ = rf'"(?:[^"\\\n]|\\(?s:.))*+(?:"|{_END})', rf"'(?:[^'\\\n]|\\(?s:.))*+(?:'|{_END})"
_STR = rf"(?:{_DQ}|{_SQ})"
_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"
_SLASHES = f"{_LINE}|{_BLOCK}"
_TREBLE = r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*+(?:"""|\z)'
_TREBLE_SQ = r"'''(?:[^'\\]|\\(?s:.)|'(?!''))*+(?:'''|\z)"
_W = f"(?:\\s|{_SLASHES})*+"
_ID = r"[\w$\x{80}-\x{10FFFF}]"
_DEEP_COMMENT = _nested(_BLOCK, r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|@)*+(?:\*/|\z)")
_RUST_RAW = r'(?<!\w)(?:b|c)?r(?<hash>#*+)"(?s:.*?)(?:"\k<hash>|\z)'
_RUST_STR = r'"(?:[^"\\]|\\(?s:.))*+(?:"|\z)'
_RUST_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*+\}|x..|.))'"
_RUST_BRACES = _nested(r"\{[^{}]*+\}", rf"\{{(?:[^{{}}\"'/]|{_SLASHES}|{_RUST_STR}|{_RUST_CHAR}|'|/|@)*+\}}", 4)
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_BEFORE_REGEX = r"(?<=(?:[(,=:\[!&|?{};+*%<>~^\n-]|\breturn|\btypeof|\bcase|\bin|\bof|\bdelete|\bvoid|\bthrow|\bnew|\belse|\bdo)[ \t]{0,8})(?<!/)"
_PLAIN_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(?:`|\z)"
_TEMPLATE = _nested(_PLAIN_TEMPLATE, rf"`(?:[^`\\$]|\\(?s:.)|\$(?!\{{)|\$\{{(?:[^`{{}}\"']|{_STR}|@|\{{[^{{}}]*+\}})*+\}})*+(?:`|\z)", 3)
_NIM_COMMENT = _nested(r"#\[(?s:.*?)(?:\]#|\z)", r"#\[(?:[^#\]]|\](?!#)|#(?!\[)|@)*+(?:\]#|\z)", 3)
_NIM_STR = rf'(?:(?<=\w)"(?:[^"\n]|"")*+"|{_DQ})'
_PY_W = r"(?:[ \t\f]|\\\r?\n)*+"
_PY_ID = r"[\w\x{80}-\x{10FFFF}]"

# What each language's scan passes over and what it stops at.
SKIPPED = {
    "c": rf'{_SLASHES}|\b(?:u8|u|U|L)?R"(?<mark>[^()\\\s"]{{0,16}}+)\((?s:.*?)(?:\)\k<mark>"|\z)|{_DQ}|{_SQ}',
    "javascript": rf"{_SLASHES}|{_PLAIN_TEMPLATE}|{_DQ}|{_SQ}|(?=[ \t/]){_BEFORE_REGEX}[ \t]*+{_REGEX}|(?=[ \t/])(?<=\)[ \t]{{0,8}})[ \t]*+{_REGEX}(?=\s*+\.\s*+(?:test|exec)\b)",
    "python": rf"{_TREBLE}|{_TREBLE_SQ}|#[^\n]*+|{_DQ}|{_SQ}",
    "go": rf"{_SLASHES}|`[^`]*+(?:`|\z)|{_DQ}|{_SQ}",
    "rust": rf"{_DEEP_COMMENT}|{_LINE}|{_RUST_RAW}|{_RUST_STR}|{_RUST_CHAR}",
    "nim": rf"##?(?={_NIM_COMMENT})|{_NIM_COMMENT}|#[^\n]*+|(?s:\"\"\"(?:.*?)(?:\"\"\"(?!\")|\z))|{_NIM_STR}|(?<=\w)'\w++|'(?:[^'\\\n]|\\[^\n])[^'\n]*+'",
    "java": rf"{_SLASHES}|{_TREBLE}|{_DQ}|{_SQ}",
    "zig": rf"//[^\n]*+|\\\\[^\n]*+|{_DQ}|{_SQ}",
}
_JS_FREE = r"(?<![\w$.?\x{80}-\x{10FFFF}])(?<![.?][ \t\n]{1,8})"
_C_W = rf"(?:[ \t]|\\\r?\n|{_BLOCK})*+"
_NIM_W = rf"(?:[ \t]|{_NIM_COMMENT})*+"
_NIM_GAP = rf"(?:\s|{_NIM_COMMENT}|#[^\n]*+)*+"
STATEMENTS = {
    "c": rf'(?:^|(?<=\*/)){_C_W}#{_C_W}include\b(?:\\\r?\n|{_BLOCK}|"[^"\n]*+"|[^\n/\\]|/(?!/)|\\)*+',
    "javascript": rf"""{_JS_FREE}(?:(?:typeof{_W}(?=import\b))?(?:import|require){_W}\({_W}{_STR}{_W}(?=[),])(?:\){_W}\.{_W}{_ID}++)?|(?:import|require){_W}\(|import{_W}{_STR}|(?:import|export)\b(?!{_W}[(.])(?:(?!\b(?:import|export)\b|\bfrom\b{_W}["'])[^;="'/]|{_SLASHES}|/|{_STR})*+\bfrom{_W}{_STR}|import\s++type\s++{_ID}++\s*+=\s*+require{_W}\({_W}{_STR}{_W}\))|{_TEMPLATE}""",
    "python": rf"""^(?<indent>[ \t]*+)if[ \t]++(?:{_PY_ID}++\.)?TYPE_CHECKING[ \t]*+:[^\n]*+(?:\n(?:\k<indent>[ \t]++[^\n]*+|[ \t]*+(?:#[^\n]*+)?(?=\n|\z)))*+|(?<![\w.])from\b{_PY_W}(?:\.|(?!import\b){_PY_ID}++|[ \t]++(?!import\b)(?=\.|{_PY_ID}))++{_PY_W}import\b{_PY_W}(?:\*|\((?:[^()#]|#[^\n]*+)*+\)?|(?:[^\n#;()"'\\]|\\\r?\n)*+)|(?<![\w.])import\b(?:{_PY_ID}|[., \t]|\\\r?\n)++|(?<![\w.])(?:importlib\s*+\.\s*+import_module|__import__)\s*+\((?:[^()"']|{_STR})*+\)?""",
    "go": rf"""(?<![\w.])import{_W}(?:\((?:[^)"'`/]|{_SLASHES}|{_DQ}|{_SQ}|`[^`]*+`|/)*+\)?|(?:[\w.\x{{80}}-\x{{10FFFF}}]++{_W})?(?:{_DQ}|`[^`]*+`))""",
    "rust": rf"""(?:#\[cfg\(test\)\]\s*+(?:#\[[^\]]*+\]\s*+)*+)?(?:\bpub(?:\s*+\([^)]*+\))?\s++)?\bmod\s++\w++\s*+(?:;|{_RUST_BRACES})|(?:#\[cfg\(test\)\]\s*+)?(?<![\w.:])use\b(?:(?!\buse\b)[^;/]|{_DEEP_COMMENT}|{_LINE})++;|\bextern\s++crate\s++\w++|\binclude!\s*+[(\[{{]|#!?\[(?:[^\[\]"]|{_RUST_STR}|\[[^\[\]]*+\])*+\](?:\s*+(?=mod\b)mod\s++\w++\s*+;)?|(?<![\w:.$'])[a-z_]\w*+(?=::[\w<{{*])""",
    "nim": rf"""(?:^|(?<=[;:]))[ \t]*+(?:import|include|from)\b(?:{_NIM_COMMENT}|,{_NIM_GAP}|\[(?:[^\[\]#"]|{_NIM_STR}|{_NIM_COMMENT}|#[^\n]*+)*+\]|\{{[^}}\n]*+\}}|{_NIM_STR}|(?<=import|include)\s*+\n[ \t]*+|[^\n#;,\[\]{{}}"])*+""",
    "java": rf"(?<![\w.$])(?:package|import){_W}(?:static\b{_W})?(?:{_ID}++{_W}\.{_W})*+(?:{_ID}++|\*){_W};|(?<![\w.$])Class{_W}\.{_W}forName{_W}\(|(?<=\.)\s*+loadClass{_W}\(",
    "zig": rf"(?:\b(?:const|var)\s++\w++\s*+(?::[^=;:]*+)?=\s*+)?@import\s*+\((?:[^()\"]|{_DQ})*+\)?(?:\s*+\.\s*+\w++)?",
}

# The characters that what is skipped or stopped at can begin with, as a class; elsewhere neither is tried,
# as looking back from every character costs most of a scan.
FIRST = {
    "c": r"[ \t\\/#uULR\"']",
    "javascript": r"[/`\"' \ttire]",
    "python": r"[\"'# \tif_]",
    "go": r"[/`\"'i]",
    "rust": r"[/\"'#a-z_]",
    "nim": r"[#\"' \tif]",
    "java": r"[/\"'\spiCl]",
    "zig": r"[/\\\"'cv@]",
}

_FOUND = "array<struct<pos:long,s:string>>"


def scanned(text: Column, language: str) -> Column:
    """pos (byte offset) and s of the statements of a text in order, comments and strings passed over."""
    tile = F.lit(f"(?m)(?s:.*?)(?:(?={FIRST[language]})(?:({STATEMENTS[language]})|{SKIPPED[language]})|\\z)")
    both = F.arrays_zip(F.regexp_extract_all(text, tile, F.lit(0)).alias("tile"), F.regexp_extract_all(text, tile, F.lit(1)).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.octet_length(x["tile"])
        here = F.array(F.struct((at - F.octet_length(x["s"])).cast("long").alias("pos"), x["s"].alias("s")))
        return F.struct(at.cast("long").alias("at"), F.when(x["s"] == "", acc["found"]).otherwise(F.concat(acc["found"], here)).alias("found"))

    return F.aggregate(both, start, step, lambda acc: acc["found"])


def statements(text: Column, language: str) -> Column:
    """The statements of a text in order."""
    return F.transform(scanned(text, language), lambda x: x["s"])


def _without_comments(s: Column, comment: str = _SLASHES, string: str = rf"{_STR}|`[^`]*+`") -> Column:
    """s with its comments as spaces; strings stay as they are. Without quotes and slashes there are neither."""
    return bound(s, lambda s: F.when(s.rlike("[/\"'`]"), F.regexp_replace(s, f"({string})|{comment}", "$1 ")).otherwise(s))


# Escapes of one letter, and what each language's strings have besides.
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
_ESCAPES = {
    "c": {"octal": r"[0-7]{1,3}", "letters": {"e": "\x1b", "a": "\a"}},
    "javascript": {"octal": "0"},
    "python": {"octal": r"[0-7]{1,3}", "letters": {"a": "\a"}},
    "go": {"octal": r"[0-7]{3}", "letters": {"a": "\a"}},
    "java": {"octal": r"[0-3]?[0-7]{1,2}", "hex": False},
    "nim": {"decimal": r"[0-9]{1,3}", "letters": {"e": "\x1b", "a": "\a"}},
}


def unescaped(c: Column, language: str = "javascript") -> Column:
    """The characters that backslashes stand for: code units and points, bytes, letters, and any other for itself."""
    has = _ESCAPES.get(language, {})
    wide = r"\\u\{[0-9a-fA-F]{1,8}\}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
    if has.get("hex", True):
        wide += r"|\\x[0-9a-fA-F]{2}"
    number = has.get("octal") or has.get("decimal")
    parts = lambda c: F.regexp_extract_all(c, F.lit(rf"{wide}{rf'|\\{number}' if number else ''}|\\\r?\n|\\(?s:.)|[^\\]+|\\"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, r"\\u|\\x|[{}]", "")
    point = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")

    def one(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\u[dD][89abAB].*\\u"), F.decode(F.unhex(digits(p)), "UTF-16BE")).when(p.rlike(f"^(?:{wide})$"), point(digits(p)))
        if number:
            out = out.when(p.rlike(rf"^\\(?:{number})$"), point(F.conv(F.substring(p, 2, 3), 8 if "octal" in has else 10, 16)))
        out = out.when(p.rlike(r"^\\\r?\n$"), "")
        for k, v in {**_LETTERS, **has.get("letters", {})}.items():
            out = out.when(p == f"\\{k}", v)
        return out.when(F.startswith(p, F.lit("\\")) & (F.length(p) > 1), F.substring(p, 2, 8) if has.get("hex", True) else p).otherwise(p)

    return bound(c, lambda c: F.when(c.contains("\\"), F.array_join(F.transform(parts(c), one), "")).otherwise(c))


def _inside(s: Column) -> Column:
    return s.substr(F.lit(2), F.length(s) - 2)


def _last_string(s: Column) -> Column:
    """What the last string of s holds."""
    held = F.regexp_extract_all(s, F.lit(_STR), F.lit(0))
    return bound(held, lambda h: F.when(F.size(h) > 0, unescaped(_inside(F.get(h, F.size(h) - 1)))))


_SPECS = "array<struct<name:string,form:string>>"


def _named(names: Column, form: str = "literal") -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(form).alias("form")))


def _one(name: Column, form: str | Column = "literal") -> Column:
    form = F.lit(form) if isinstance(form, str) else form
    return F.filter(F.transform(F.array(name), lambda n: F.struct(n.alias("name"), form.alias("form"))), lambda x: x["name"] != "")


def _listed(s: Column) -> Column:
    """Names parted by commas, aliases and brackets gone."""
    parts = F.split(F.regexp_replace(s, r"#[^\n]*|[()\\\n\r\t]", " "), ",")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\s+as\s.*$", ""), r"\s", "")), lambda p: p.rlike(rf"^[.\w*\x{{80}}-\x{{10FFFF}}]+$"))


def _python(s: Column) -> Column:
    base = lambda flat: F.regexp_replace(F.regexp_extract(flat, r"(?s)^from\s*(.*?)\s*\bimport\b", 1), r"\s", "")
    return bound(F.regexp_replace(s, r"\\\r?\n", " "), lambda flat: bound(base(flat), lambda b: _python_names(flat, b)))


def _python_names(flat: Column, base: Column) -> Column:
    dotted = F.when(F.endswith(base, F.lit(".")), base).otherwise(F.concat(base, F.lit(".")))
    after = F.filter(_listed(F.regexp_extract(flat, r"(?s)^from.*?\bimport\b(.*)$", 1)), lambda n: n != "*")
    star = flat.rlike(r"(?s)\bimport\s*\*\s*$")
    pulled = F.concat(F.array(F.struct(base.alias("name"), F.when(star, "star").otherwise("base").alias("form"))), F.transform(after, lambda n: F.struct(F.concat(dotted, n).alias("name"), F.lit("member").alias("form"))))
    return F.when(flat.rlike("^(importlib|__import__)"), _one(loaded(flat))).when(base != "", pulled).otherwise(_named(_listed(F.regexp_replace(flat, r"^import\b", ""))))


def loaded(s: Column) -> Column:
    """The module that a loader call with literal arguments imports, relative names taken from their package; or null."""
    args = F.regexp_extract_all(s, F.lit(_STR), F.lit(0))
    name, package = unescaped(_inside(F.get(args, F.lit(0)))), unescaped(_inside(F.get(args, F.lit(1))))
    literal = s.rlike(rf"^importlib[^(]*\(\s*{_STR}\s*(?:,\s*(?:package\s*=\s*)?{_STR}\s*)?\)")
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    parts = F.split(package, r"\.")
    anchor = F.when(F.size(parts) >= dots, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "."))
    rest = F.regexp_replace(name, r"^\.+", "")
    relative = F.when(package.isNotNull() & (anchor != ""), F.when(rest == "", anchor).otherwise(F.concat(anchor, F.lit("."), rest)))
    own = F.when(literal & (name != ""), F.when(dots == 0, name).otherwise(relative))
    return F.when(F.startswith(s, F.lit("__import__")), F.when(s.rlike(rf"^__import__\s*\(\s*{_STR}\s*[),]") & (dots == 0) & (name != ""), name)).otherwise(own)


def _rust_tree(path: Column) -> Column:
    """The paths of a use tree: the innermost braces are multiplied out, level by level."""
    inner = r"^(?<b>.*?)(?<p>[^{},]*)\{(?<i>[^{}]*)\}(?<a>.*)$"

    def spread(p: Column) -> Column:
        before, prefix, inside, after = (F.regexp_extract(p, inner, k) for k in (1, 2, 3, 4))
        parts = F.filter(F.split(inside, ","), lambda x: x != "")
        # a member that is itself the end of a path (self) keeps the prefix
        return F.when(p.contains("{"), F.concat(before, F.array_join(F.transform(parts, lambda x: F.concat(prefix, x)), ","), after)).otherwise(p)

    # the path is bound as the state of an aggregation: as an expression it would be written out anew each time
    out = F.aggregate(F.sequence(F.lit(1), F.lit(NESTED)), path, lambda p, _: spread(p))
    return F.filter(F.split(out, ","), lambda x: (x != "") & ~x.contains("{"))


def _rust(s: Column) -> Column:
    return bound(F.regexp_replace(_without_comments(s, f"{_DEEP_COMMENT}|{_LINE}", _RUST_STR), r"^(?:#\[[^\]]*\]\s*)+", ""), lambda bare: _rust_names(s, bare))


def _rust_names(s: Column, bare: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"(?s)^use\b\s*(.+);$", 1), r"\s+as\s+\w+", ""), r"\s", "")
    uses = F.filter(F.transform(_rust_tree(path), lambda u: F.regexp_replace(u, r"::(\*|self)$", "")), lambda u: ~u.isin("*", "self", "crate", "super") & (u != ""))
    mod = F.regexp_extract(bare, r"^(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+(\w+)\s*;", 1)
    crate = F.regexp_extract(bare, r"^extern\s+crate\s+(\w+)", 1)
    word = F.regexp_extract(bare, r"^([a-z_]\w*)$", 1)
    form = lambda u: F.when(u.rlike("^(crate|self|super)::"), "use").otherwise("crate")
    pathed = s.rlike(r"^#\[\s*path\b")
    return (
        F.when(pathed, F.array().cast(_SPECS))
        .when(mod != "", _one(mod, "mod"))
        .when((crate != "") & (crate != "self"), _one(crate, "crate"))
        .when(F.startswith(bare, F.lit("use")), F.transform(uses, lambda u: F.struct(u.alias("name"), form(u).alias("form"))))
        .otherwise(_one(word, "path"))
    )


def _nim(s: Column) -> Column:
    """Modules of an import, include or from; nothing where an operand is no path, group or plain string."""
    said = F.trim(F.regexp_replace(F.regexp_replace(s, rf"({_NIM_STR})|{_NIM_COMMENT}|#[^\n]*", "$1"), r"\{[^}\n]*\}", ""))
    body = F.regexp_replace(said, r"^(import|include|from)\b\s*", "")
    body = F.when(F.startswith(said, F.lit("from")), F.regexp_extract(body, r"(?s)^(.*?)\s+import\b", 1)).otherwise(F.regexp_replace(body, r"(?s)\s+except\b.*$", ""))
    parts = F.regexp_extract_all(body, F.lit(r"[^,\[]+(?:\[[^\]]*\])?"), F.lit(0))
    bare = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\s+as\s+\w+\s*$", ""), r"\"|\s", ""), r"(?<=\w)\.(?=\w)", "/")

    def spread(p: Column) -> Column:
        head, inside = F.regexp_extract(p, r"(?s)^([^\[]*)", 1), F.regexp_extract(p, r"(?s)\[([^\]]*)\]", 1)
        members = F.filter(F.split(inside, ","), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
        return F.when(p.contains("["), F.transform(members, lambda x: F.concat(bare(head), bare(F.trim(x))))).otherwise(F.array(bare(F.trim(p))))

    names = F.filter(F.flatten(F.transform(parts, spread)), lambda n: n != "")
    readable = (F.size(names) > 0) & ~F.exists(names, lambda n: ~n.rlike(r"^[\w./\x{80}-\x{10FFFF}-]+$") | F.endswith(n, F.lit("/")))
    return F.when(readable, _named(names)).otherwise(F.array().cast(_SPECS))


def _java(s: Column) -> Column:
    return bound(F.regexp_replace(_without_comments(s), r"\s+", " "), _java_names)


def _java_names(bare: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(bare, r"^import (?:static )?(.+);$", 1), " ", "")
    whole = lambda n: F.regexp_replace(F.when(n == "", F.regexp_extract(bare, r"^import (.+);$", 1)).otherwise(n), r"^static(?=\s)", "")
    return bound(bound(name, whole), lambda n: _java_spec(bare, n))


def _java_spec(bare: Column, name: Column) -> Column:
    star = F.endswith(name, F.lit(".*"))
    static = F.startswith(bare, F.lit("import static "))
    return _one(name, F.when(static, F.when(star, "static_star").otherwise("static")).when(star, "star").otherwise("literal"))


def _specs(s: Column, language: str) -> Column:
    if language == "python":
        return _python(s)
    if language == "rust":
        return _rust(s)
    if language == "nim":
        return _nim(s)
    if language == "java":
        return _java(s)
    if language == "go":
        found = F.regexp_extract_all(s, F.lit(rf"{_SLASHES}|{_DQ}|`[^`]*+`"), F.lit(0))
        held = F.transform(F.filter(found, lambda x: x.rlike('^["`].*["`]$')), lambda x: F.when(F.startswith(x, F.lit('"')), unescaped(_inside(x), "go")).otherwise(_inside(x)))
        return _named(held)
    if language == "c":
        name = F.regexp_extract(F.regexp_replace(s, r"\\\r?\n", " "), rf'#{_C_W}include{_C_W}(?:"([^"\n]*)"|<[^>\n]*>){_C_W}$', 1)
        angle = F.regexp_extract(F.regexp_replace(s, r"\\\r?\n", " "), rf"#{_C_W}include{_C_W}<([^>\n]*)>{_C_W}$", 1)
        return _one(F.when(name != "", name).otherwise(angle))
    if language == "zig":
        return _one(F.when(s.rlike(rf"(?s)@import\s*\(\s*{_DQ}\s*,?\s*\)"), _last_string(s)))
    none = lambda bare: bare.rlike(r"(?s)(import|require)\s*\($") | F.startswith(s, F.lit("`"))
    return bound(_without_comments(s), lambda bare: F.when(none(bare), F.array().cast(_SPECS)).otherwise(_one(_last_string(bare))))


def _kind(s: Column, language: str) -> Column:
    if language == "javascript":
        return bound(F.regexp_replace(_without_comments(s), r"\s+", " "), _javascript_kind)
    if language == "python":
        return F.when(s.rlike(r"^(importlib|__import__)"), "dynamic").otherwise("import")
    if language == "rust":
        return F.when(s.rlike(r"^#\[cfg\(test\)\]|^(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+tests\s*;"), "test").otherwise("import")
    return F.lit("import")


def _javascript_kind(bare: Column) -> Column:
    called = bare.rlike(r"^(typeof )?import ?\(")
    member = F.regexp_extract(bare, rf"\) ?\. ?({_ID}+)$", 1)
    whole = bare.rlike(r"^(import|export) ?type (?!(from ['\"]|,))|^(import|export) ?type ?[{*]")
    braces = F.regexp_extract(bare, r"^(?:import|export) ?\{([^}]*)\} ?from\b", 1)
    each = F.filter(F.transform(F.split(braces, ","), lambda x: F.trim(x)), lambda x: x != "")
    marked = (F.size(each) > 0) & F.forall(each, lambda x: x.rlike(r"^type (?!as( |$))\S"))
    typed = F.startswith(bare, F.lit("typeof")) | (called & (member != "") & ~member.isin("then", "catch", "finally")) | bare.rlike(r"^import type \S+ ?= ?require")
    return F.when(typed | (~called & (whole | marked)), "type_only").when(called, "dynamic").otherwise("import")


def _unfolded(files: DataFrame, language: str) -> DataFrame:
    """src, pos, sub, scope, inner (what the statement stands in: null, type_only, test) and s of every statement."""
    # of the outer kind: for any other Spark computes the array twice, to pass over empty ones
    rows = files.select(F.col("path").alias("src"), F.explode_outer(scanned(F.col("text"), language)).alias("x")).where("x is not null")
    rows = rows.select("src", F.col("x.pos").alias("pos"), F.lit(0).alias("sub"), F.lit("").alias("scope"), F.lit(None).cast("string").alias("inner"), F.col("x.s").alias("s"))
    holds, mark, text, name = {
        "python": (r"^[ \t]*+if\b", F.lit("type_only"), F.regexp_replace("s", r"^[ \t]*+if[^:]*+:", ""), F.lit("")),
        "rust": (r"(?s)^(?:#\[[^\]]*+\]\s*+)*+(?:pub(?:\s*+\([^)]*+\))?\s++)?mod\s++\w++\s*+\{", F.when(F.col("s").rlike(r"^#\[cfg\(test\)\]|\bmod\s+tests\s*\{"), "test"), F.regexp_extract("s", r"(?s)^[^{]*\{(.*)\}$", 1), F.regexp_extract("s", r"\bmod\s+(\w+)\s*\{", 1)),
        "javascript": ("^`", F.lit(None).cast("string"), F.array_join(F.regexp_extract_all("s", F.lit(r"\$\{((?:[^`{}]|`[^`]*+`|\{[^{}]*+\})*+)\}"), F.lit(1)), ";"), F.lit("")),
    }.get(language, (None, None, None, None))
    if holds is None:
        return rows
    rows = settle(rows, "statements")  # texts are matched once, whatever is read of their statements
    out = rows.where(~F.col("s").rlike(holds))
    for _ in range(2):
        block = rows.where(F.col("s").rlike(holds))
        if block.head() is None:
            break
        before = F.octet_length("s") - F.octet_length(text) if language == "python" else F.lit(0)
        deeper = F.when((F.col("scope") == "") | (name == ""), F.concat("scope", name)).otherwise(F.concat("scope", F.lit("/"), name))
        inside = block.select("src", "pos", "sub", deeper.alias("scope"), F.coalesce("inner", mark).alias("inner"), before.alias("_b"), F.posexplode(scanned(text, language)).alias("_n", "x"))
        place = F.col("pos") + F.col("_b") + F.col("x.pos") if language == "python" else F.col("pos")
        rows = inside.select("src", place.alias("pos"), (F.col("sub") * 1000 + F.col("_n") + 1).alias("sub"), "scope", "inner", F.col("x.s").alias("s"))
        rows = settle(rows, "statements")  # so are those within them
        out = out.unionByName(rows.where(~F.col("s").rlike(holds)))
    return out


def imports(files: DataFrame, language: str) -> DataFrame:
    """src, pos, ord, name, form, kind (and scope in Rust) of every import in files (path, text) of one language."""
    rows = _unfolded(files, language)
    kind = F.coalesce("inner", _kind(F.col("s"), language))
    wide = rows.select("src", "pos", "sub", "scope", kind.alias("kind"), F.posexplode_outer(_specs(F.col("s"), language)).alias("n", "spec")).where("spec is not null")
    found = wide.select("src", "pos", (F.col("sub") * 1000 + F.col("n")).alias("ord"), F.col("spec.name").alias("name"), F.col("spec.form").alias("form"), "kind", "scope")
    if language == "rust":
        found = _rust_crates(found)
    return found.drop("scope") if language != "rust" else found


def _rust_crates(found: DataFrame) -> DataFrame:
    """A file's crates: words before `::` in code count once a file and kind, unless the file brings that name into scope
    by a use, a module or an extern crate. A use of a module that the file declares is one from where the file is."""
    declared = found.where("form <> 'path'")
    names = declared.select("src", F.when(F.col("form") == "mod", F.col("name")).when(F.col("form") == "crate", F.element_at(F.split("name", "::"), -1)).otherwise(F.element_at(F.split("name", "::"), -1)).alias("name")).distinct()
    mods = declared.where("form = 'mod'").select("src", F.col("name").alias("root"), F.lit(True).alias("own")).distinct()
    root = F.regexp_extract("name", "^(?:::)?([^:]+)", 1)
    uses = declared.withColumn("root", root).join(mods.hint("merge"), ["src", "root"], "left")
    uses = uses.withColumn("form", F.when((F.col("form") == "crate") & F.col("own") & ~F.startswith("name", F.lit("::")), "use").otherwise(F.col("form")))
    uses = uses.withColumn("name", F.regexp_replace("name", "^::", "")).where(~((F.col("form") == "crate") & F.col("root").isin("std", "core", "alloc", "proc_macro", "test")))
    words = found.where("form = 'path'").where(~F.col("name").isin("std", "core", "alloc", "proc_macro", "test", "crate", "self", "super")).join(names.hint("merge"), ["src", "name"], "left_anti")
    first = words.groupBy("src", "name", "kind").agg(F.min("pos").alias("pos"), F.min("ord").alias("ord"), F.first("scope").alias("scope")).withColumn("form", F.lit("crate"))
    columns = ["src", "pos", "ord", "name", "form", "kind", "scope"]
    return uses.select(*columns).unionByName(first.select(*columns))


def unsupported(files: DataFrame, language: str) -> DataFrame:
    """path, offset, expression of the constructs of one language whose target is not written out."""
    rows = _unfolded(files, language)
    s = F.col("s")
    empty = F.size(_specs(s, language)) == 0
    bare = F.regexp_replace(_without_comments(s), r"\s", "")
    # fixed values: what such a construct is called
    expression = {
        "c": F.when(empty, "c_include"),
        "javascript": F.when(bare.rlike(r"^(typeof)?import\($"), "javascript_import").when(bare.rlike(r"^require\($"), "javascript_require"),
        "python": F.when(empty & F.startswith(s, F.lit("importlib")), "python_importlib").when(empty & F.startswith(s, F.lit("__import__")), "python_import"),
        "rust": F.when(s.rlike(r"^#!?\[\s*path\b"), "rust_path").when(F.startswith(s, F.lit("include!")), "rust_include"),
        "nim": F.when(empty, F.when(F.trim(s).rlike("^include"), "nim_include").otherwise("nim_import")),
        "java": F.when(F.startswith(s, F.lit("Class")), "java_for_name").when(F.trim(s).rlike("^loadClass"), "java_load_class"),
        "zig": F.when(empty & s.contains("@import"), "zig_import"),
        "go": F.lit(None).cast("string"),
    }[language]
    return rows.select(F.col("src").alias("path"), F.col("pos").alias("offset"), expression.alias("expression")).where("expression is not null")


def zig_members(files: DataFrame) -> DataFrame:
    """src, name, member: the members of imports that a Zig text uses, directly or by the name it binds the import to."""
    found = files.select(F.col("path").alias("src"), "text", F.explode(statements(F.col("text"), "zig")).alias("s"))
    found = found.withColumn("name", _last_string(F.col("s"))).where("name is not null")
    direct = found.select("src", "name", F.regexp_extract("s", r"\)\s*\.\s*(\w+)$", 1).alias("member")).where("member <> ''")
    named = found.where(~F.col("s").rlike(r"\)\s*\.\s*\w+$")).select("src", "name", F.regexp_extract("s", r"^(?:const|var)\s+(\w+)", 1).alias("as")).where("as <> ''")
    code = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(rf"(?m){SKIPPED['zig']}|(?<![\w.@])\w++\s*+\.\s*+\w++"), F.lit(0))).alias("x"))
    uses = code.where(F.col("x").rlike(r"^\w+\s*\.")).select("src", F.regexp_extract("x", r"^(\w+)", 1).alias("as"), F.regexp_extract("x", r"(\w+)$", 1).alias("member"))
    return direct.unionByName(uses.join(named.hint("merge"), ["src", "as"]).select("src", "name", "member"))


def java_packages(files: DataFrame) -> DataFrame:
    """path, package, simple of every Java file but descriptors."""
    of = F.filter(statements(F.col("text"), "java"), lambda s: F.startswith(s, F.lit("package")))
    package = F.coalesce(F.regexp_extract(F.regexp_replace(_without_comments(F.get(of, F.lit(0))), r"\s", ""), r"^package(.+);$", 1), F.lit(""))
    rows = files.select("path", package.alias("package"), F.regexp_extract("path", r"([^/]*)\.java$", 1).alias("simple"))
    return rows.where(~F.col("simple").isin("package-info", "module-info"))


def markdown_links(files: DataFrame) -> DataFrame:
    """src, pos, name, member ("wiki" or null) of the links to other files in Markdown."""
    return markdown.links(files).withColumn("name", percent_decoded(F.col("name")))


def percent_decoded(c: Column) -> Column:
    """%XX becomes its byte; any other % stays."""
    parts = F.regexp_extract_all(c, F.lit(r"(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}"), F.decode(F.unhex(F.replace(p, F.lit("%"), F.lit(""))), "UTF-8")).otherwise(p)), "")


def asset_paths(files: DataFrame) -> DataFrame:
    """src, pos, name: maximal runs of path characters, three bytes at least."""
    runs = F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z./_@\-\x{80}-\x{10FFFF}]++"), F.lit(0))
    return files.select(F.col("path").alias("src"), F.posexplode(runs).alias("pos", "name")).where(F.octet_length("name") >= 3)


# Words, numbers and the operators that are one piece of code, the longest first.
_NUMBER = r"(?<![\w$.])(?:\d[\w.]*+|\.\d[\w.]*+)"
_WORD = r"[\p{L}_$\x{80}-\x{10FFFF}][\w$\x{80}-\x{10FFFF}]*+"
_OPERATOR = r">>>=|<<=|>>=|\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|>>>|::|->|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[^\s\w$]"
_PLAIN_STRING = r"""^(?:"(?!"")|'(?!'')|`)"""


def _lexemes(files: DataFrame, language: str) -> DataFrame:
    """path, pos (byte offset), s, what (identifier, number, string, trivia, other) of every piece of code, in order."""
    first = {"zig": rf"@{_DQ}|", "javascript": f"{_TEMPLATE}|"}.get(language, "")
    piece = f"{first}{SKIPPED[language]}|{_NUMBER}|{_WORD}|{_OPERATOR}"
    tile = F.lit(f"(?m)\\s*+(?:({piece})|\\z|(?s:.))")
    both = F.arrays_zip(F.regexp_extract_all("text", tile, F.lit(0)).alias("tile"), F.regexp_extract_all("text", tile, F.lit(1)).alias("s"))
    rows = files.select("path", F.posexplode(both).alias("n", "x")).select("path", "n", F.col("x.tile").alias("tile"), F.col("x.s").alias("s"))
    comment = {"python": "^#", "nim": "^#"}.get(language, r"^(?://|/\*)")
    s = F.col("s")
    quotes = {"go": r'^["`]', "javascript": r"""^["']""", "python": r"""^(?:"(?!"")|'(?!''))"""}.get(language, r'^"(?!"")')
    what = F.when(F.startswith(s, F.lit('@"')), "identifier").when(s.rlike(comment), "trivia").when(s.rlike(quotes), "string").when(s.rlike(rf"""^["'`]|^\\\\|^(?:b|c)?r#*"|^(?:u8|u|U|L)?R\""""), "other").when(s.rlike(f"^{_WORD}$"), "identifier").when(s.rlike(r"^\.?\d"), "number").otherwise("code")
    return rows.withColumn("what", what)


def tokens(files: DataFrame, language: str, sequences: int = 0) -> DataFrame:
    """path, kind (identifier, string, sequence), text, offset (bytes), line and column (from 1, in bytes) of what token
    rules look at: identifiers, decoded strings and, up to so many pieces, runs of code joined by spaces. Strings,
    comments and character literals hold no identifiers; numbers are none; a string ends a run."""
    rows = _lexemes(files, language)
    order = Window.partitionBy("path").orderBy("n")
    by = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a file is one value, and so are its pieces; lines are counted along with the bytes
    last = F.substring_index("tile", "\n", -1)
    newlines = F.length("tile") - F.length(F.replace("tile", F.lit("\n"), F.lit("")))
    rows = rows.withColumn("end", F.sum(F.octet_length("tile")).over(by)).withColumn("offset", F.col("end") - F.octet_length("s"))
    rows = rows.withColumn("_own", F.length("s") - F.length(F.replace("s", F.lit("\n"), F.lit(""))))
    rows = rows.withColumn("line", F.sum(newlines).over(by) - F.col("_own") + 1)
    broke = F.when(newlines > 0, F.col("end") - F.octet_length(last))
    start = F.coalesce(F.max(F.when((newlines > 0) & (F.col("_own") == 0), broke)).over(by), F.lit(0))
    before = F.coalesce(F.max(broke).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("column", F.col("offset") - F.greatest(start, before) + 1).where("s <> ''")
    raw = F.lag("s").over(order).rlike("^(?i:[bu]?r[b]?)$") & (F.length("tile") == F.length("s"))
    rows = rows.withColumn("raw", F.coalesce(raw & F.lit(language in ("python", "nim")), F.lit(False)))
    plain = F.when(F.col("raw"), _inside(F.col("s"))).when(F.col("what") == "string", _decoded(F.col("s"), language)).when(F.startswith("s", F.lit('@"')), _decoded(F.expr("substring(s, 2)"), language)).otherwise(F.col("s"))
    out = rows.where("what in ('identifier', 'string')").select("path", F.col("what").alias("kind"), plain.alias("text"), "offset", "line", "column")
    if not sequences:
        return out
    code = rows.where("what <> 'trivia'").withColumn("code", F.col("what").isin("identifier", "number", "code"))
    code = code.withColumn("run", F.sum((~F.col("code")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("code")
    ahead = F.collect_list("s").over(Window.partitionBy("path", "run").orderBy("n").rowsBetween(0, sequences - 1))
    wide = code.withColumn("ahead", ahead).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ahead"))))
    runs = wide.select("path", F.lit("sequence").alias("kind"), F.array_join(F.slice("ahead", F.lit(1), F.col("k")), " ").alias("text"), "offset", "line", "column")
    return out.unionByName(runs)


def _decoded(s: Column, language: str) -> Column:
    """What a string literal says."""
    closed = s.rlike(r"""(?s)^(.).*\1$""")
    plain = s.substr(F.lit(2), F.length(s) - F.when(closed, 2).otherwise(1))
    return F.when(F.startswith(s, F.lit("`")), plain).otherwise(unescaped(plain, language))
