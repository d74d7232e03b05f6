"""Patterns as Java regular expressions: of paths, of names and of tokens. Compiled once on the driver."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "*?[\\"


class InvalidPattern(ValueError):
    """An unclosed bracket or an escape with nothing behind it."""


def literal(pattern: str) -> bool:
    return not any(c in pattern for c in SPECIAL)


def _component(text: str, any_char: str = "[^/]") -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while text[i + 1 : i + 2] == "*":
                i += 1
            out.append(f"{any_char}*")
        elif c == "?":
            out.append(any_char)
        elif c == "\\":
            i += 1
            if i == len(text):
                raise InvalidPattern(text)
            out.append(re.escape(text[i]))
        elif c == "[":
            end = text.find("]", i + (3 if text[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                raise InvalidPattern(text)
            body = text[i + 1 : end]
            negated = body.startswith("!")
            inside = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
            out.append(f"(?!/)[{'^' if negated else ''}{inside}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


@lru_cache(4096)
def compiled(pattern: str, anywhere: bool = True) -> str:
    """An anchored regular expression. `**` as a whole component spans any number of components; a pattern without
    a slash is matched against the last component where `anywhere` holds, and against everything where not."""
    parts = pattern.split("/")
    if pattern == "**":
        return "(?s)^.*$"
    if len(parts) == 1:
        return f"(?s)^{'(?:.*/)?' if anywhere else ''}{_component(pattern)}$"
    out = ""
    for k, part in enumerate(parts):
        if part == "**":
            out += ".+" if k == len(parts) - 1 else "(?:[^/]+/)*"
        else:
            out += _component(part) + ("/" if k < len(parts) - 1 else "")
    return f"(?s)^{out}$"


@lru_cache(4096)
def compiled_token(pattern: str) -> str:
    """Only `*` (anything, slashes too) and `?` (one character) are special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(value: Column, pattern: str, anywhere: bool = True) -> Column:
    """Literal patterns are compared, which reaches the scan; `dir/**` is a prefix; others are matched."""
    if literal(pattern) and ("/" in pattern or not anywhere):
        return value == pattern
    if pattern.endswith("/**") and literal(pattern[:-3]):
        return F.startswith(value, F.lit(pattern[:-2])) & (F.length(value) > len(pattern) - 2)
    return value.rlike(compiled(pattern, anywhere))


def matches_token(value: Column, pattern: str) -> Column:
    if "*" not in pattern and "?" not in pattern:
        return value == pattern
    return value.rlike(compiled_token(pattern))


def matches_sequence(value: Column, pattern: str) -> Column:
    """Tokens parted by single spaces against as many patterns."""
    parts = ["".join("[^ ]*" if c == "*" else "[^ ]" if c == "?" else re.escape(c) for c in p) for p in pattern.split(" ")]
    return value.rlike("(?s)^" + " ".join(parts) + "$")


def any_of(value: Column, patterns, anywhere: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(value, p, anywhere)
    return out
