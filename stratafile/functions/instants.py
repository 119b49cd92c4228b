"""Instants given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

_ISO = r"\A(?!0000)\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?\z"


def instant_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO date and time, NULL if it can't be read.

    T or a blank stands between date and time, up to six decimals, zone Z, +hh:mm, -hh:mm or none (UTC).
    It doesn't depend on the session's time zone: the zone is taken off and its offset subtracted.
    """
    x = as_column(c)
    zoned = F.substring(x, -6, 1).isin("+", "-") & (F.substring(x, -3, 1) == ":")
    local = F.when(zoned, F.substring(x, F.lit(1), F.length(x) - 6)).otherwise(F.rtrim(x, F.lit("Z")))
    micros = F.unix_micros(F.concat(local, F.lit("Z")).try_cast("timestamp"))
    minutes = F.substring(x, -5, 2).try_cast("int") * 60 + F.substring(x, -2, 2).try_cast("int")
    offset = F.when(zoned, F.when(F.substring(x, -6, 1) == "-", -minutes).otherwise(minutes)).otherwise(0)
    return F.when(x.rlike(_ISO), micros - offset.cast("long") * 60_000_000)
