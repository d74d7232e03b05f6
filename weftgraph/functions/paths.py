"""Paths of files as columns: relative, byte-exact, components parted by one slash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(p: Column | str) -> Column:
    return F.col(p) if isinstance(p, str) else p


def bound(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), with c computed once however often `of` names it: an expression is written out anew at each place."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def valid(p: Column | str) -> Column:
    """Neither empty, absolute, on a drive, nor holding a backslash or NUL."""
    p = _col(p)
    return (p != "") & ~p.rlike(r"^/|^[A-Za-z]:|\\|\x00")


def normalize(p: Column | str) -> Column:
    """The path without empty, `.` and `..` components; null where it is refused or leads above the root."""
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))  # noqa: E731  null above the root
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    walked = lambda p: F.aggregate(parts(p), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return bound(_col(p), lambda p: F.when(valid(p), bound(walked(p), lambda w: F.when(F.size(w) > 0, F.array_join(w, "/")))))


def dirname(p: Column | str) -> Column:
    """What stands before the last slash, or the empty string."""
    return F.regexp_replace(_col(p), "/?[^/]*$", "")


def basename(p: Column | str) -> Column:
    return F.substring_index(_col(p), "/", -1)


def within(root: Column | str, p: Column | str) -> Column:
    """Whether p is root or lies below it; the empty root holds all."""
    root, p = _col(root), _col(p)
    return (root == "") | (p == root) | F.startswith(p, F.concat(root, F.lit("/")))


def directory(p: Column | str, depth: int) -> Column:
    """The first `depth` directories of p, `.` where there are none."""
    if depth <= 0:
        return F.lit(".")
    d = dirname(p)
    return F.when(d == "", F.lit(".")).otherwise(F.array_join(F.slice(F.split(d, "/"), 1, depth), "/"))


def ancestors(p: Column | str, root: bool = False) -> Column:
    """All directories above p, from the top; the root ("") first if asked for."""
    d = dirname(p)
    parts = F.split(d, "/")
    found = F.when(d == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.concat(F.array(F.lit("")), found) if root else found


def joined(base: Column | str, name: Column | str) -> Column:
    """name as seen from the directory base, normalized; null for an absolute name."""
    base, name = _col(base), _col(name)
    under = lambda b: F.when(b == "", name).otherwise(F.concat(b, F.lit("/"), name))
    return F.when(valid(name), normalize(bound(base, under)))
