"""Paths and path filters as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

#: An escape character that no path holds, so that a backslash in a pattern is itself.
NO_ESCAPE = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A to Z only, as the catalog's text comparison folds it."""
    return F.translate(as_column(c), _UPPER, _LOWER)


def like(c: Column | str, pattern: str) -> Column:
    """LIKE with % and _ live, without case for A to Z, and no escape character. NULL stays NULL."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER))
    return F.like(ascii_lower(c), F.lit(folded), F.lit(NO_ESCAPE))


def prefix_filter(c: Column | str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Path filter: under any included prefix (all, if there is none) and under no excluded one.

    Closing separators of a prefix are dropped, and its end need not be a separator; % and _ in it are wildcards.
    A NULL path passes only if there is no prefix at all.
    """

    def under(prefixes: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, (like(c, p.rstrip("\\/") + "%") for p in prefixes))

    keep = F.lit(True)
    if include:
        keep = keep & under(include)
    if exclude:
        keep = keep & ~under(exclude)
    return keep


def not_containing(c: Column | str, patterns: Sequence[str]) -> Column:
    """Whether a path holds none of the patterns, literally and with case; empty patterns count for nothing."""
    return reduce(lambda a, b: a & b, (~F.contains(as_column(c), F.lit(p)) for p in patterns if p), F.lit(True))


def name_of(c: Column | str) -> Column:
    """What follows the last separator, of either kind."""
    return F.regexp_extract(as_column(c), r"([^\\/]*)\z", 1)


def dir_of(c: Column | str) -> Column:
    """The path without its last separator and what follows; the empty string if there is none."""
    return F.regexp_extract(as_column(c), r"(?s)\A(.*)[\\/][^\\/]*\z", 1)


def suffix_of(c: Column | str) -> Column:
    """Last suffix of a name in lower case, with its dot: empty if the name has none, begins with its only dot or ends with a dot."""
    return F.lower(F.regexp_extract(as_column(c), r"(?s)\A.+(\.[^.]+)\z", 1))


def ancestors(directory: Column | str) -> Column:
    """Array of (path, depth): each ancestor of a directory and itself, joined with /; depth 1 is the first named part."""
    parts = F.filter(F.split(F.regexp_replace(as_column(directory), r"\\", "/"), "/"), lambda p: p != "")
    return F.transform(parts, lambda _, i: F.struct(F.array_join(F.slice(parts, 1, i + 1), "/").alias("path"), (i + 1).alias("depth")))


def relative_to(c: Column | str, prefix: str) -> Column:
    """What follows a prefix's length; (root) where nothing does."""
    rest = F.substring(as_column(c), len(prefix) + 1, 2**31 - 1)
    return F.when(rest == "", "(root)").otherwise(rest)


def quoted(c: Column | str) -> Column:
    """With a backslash before every double quote."""
    return F.replace(as_column(c), F.lit('"'), F.lit('\\"'))
