"""Normal forms of catalog text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Unicode counts as white space, as str.strip() removes them.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends; NULL stays NULL."""
    return F.btrim(as_column(c), F.lit(WHITE_SPACE))


def code(c: Column | str) -> Column:
    """Trimmed, in lower case: how ext, state and digests are compared."""
    return F.lower(trimmed(c))


def ext_key(c: Column | str) -> Column:
    """Extension as a key: trimmed, lower case, NULL as the empty string."""
    return F.coalesce(code(c), F.lit(""))


def path_key(c: Column | str) -> Column:
    """Path as a key: lower case, not trimmed."""
    return F.lower(as_column(c))


def root_key(c: Column | str) -> Column:
    """Root as a key: lower case, without closing separators."""
    return F.rtrim(F.lower(as_column(c)), F.lit("\\/"))


def is_active(state: Column | str) -> Column:
    """True unless the state is error, missing, blank or NULL."""
    return F.coalesce(~code(state).isin("error", "missing", ""), F.lit(False))


def has_code(codes: Column | str, wanted: str) -> Column:
    """Whether a text of codes holds one as a whole code; False for NULL."""
    return F.coalesce(F.lower(as_column(codes)).rlike(f"(?<![a-z0-9_]){wanted}(?![a-z0-9_])"), F.lit(False))


def _digest(c: Column | str, lengths: tuple[int, ...]) -> Column:
    x = code(c)
    shape = "|".join(f"[0-9a-f]{{{n}}}" for n in lengths)
    return F.when(x.rlike(rf"\A(?:{shape})\z") & (F.replace(x, F.substring(x, 1, 1), F.lit("")) != ""), x)


def valid_sha256(c: Column | str) -> Column:
    """The digest trimmed and in lower case, or NULL: 64 hex digits that are not all the same."""
    return _digest(c, (64,))


def valid_quick_hash(c: Column | str) -> Column:
    """As valid_sha256, with 16 or 40 digits."""
    return _digest(c, (16, 40))
