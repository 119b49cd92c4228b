"""Sizes, durations and numbers as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, trimmed

# Units of 1024 to the power of their place, from 1.
UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]


def format_bytes(c: Column | str, decimals: int = 1, last_unit: str = "EB") -> Column:
    """Size with a unit: plain bytes below 1024, else the largest unit with a value of at least 1, up to last_unit. The explorer shows one decimal, the log monitor two, the workload report two and no unit over GB. NULL becomes the empty string."""
    x = as_column(c).cast("double")
    units = UNITS[: UNITS.index(last_unit) + 1]
    out = F.format_string(f"%.{decimals}f {units[-1]}", x / float(1024 ** len(units)))
    for k in range(len(units) - 1, 0, -1):
        out = F.when(x < float(1024 ** (k + 1)), F.format_string(f"%.{decimals}f {units[k - 1]}", x / float(1024**k))).otherwise(out)
    return F.when(x.isNull(), "").when(x < 1024, F.concat(x.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def format_duration(seconds: Column | str) -> Column:
    """[Nd ]HH:MM:SS of a number of seconds; negative ones count as 0."""
    s = F.greatest(as_column(seconds).cast("long"), F.lit(0))
    days = F.floor(s / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), s % 60)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock)).otherwise(clock)


def parse_human_size(c: Column | str) -> Column:
    """Bytes of a text such as 1.5 GB: a number with commas, then a unit of 1024 to a power up to TB; an unknown unit counts as bytes, an unreadable number gives NULL. Truncated to whole bytes."""
    parts = F.split(trimmed(c), r"\s+")
    number = F.replace(F.get(parts, F.lit(0)), F.lit(","), F.lit("")).try_cast("double")
    unit = F.upper(F.get(parts, F.lit(1)))
    power = F.when(unit == "KB", 1).when(unit == "MB", 2).when(unit == "GB", 3).when(unit == "TB", 4).otherwise(0)
    return F.when(~F.isnan(number), (number * F.pow(F.lit(1024.0), power)).try_cast("long"))


def summary_values(c: Column | str, width: int = 6) -> Column:
    """Array of the leading whole numbers of a summary line, commas removed, up to the first other token; filled with 0 or cut to `width`. NULL if there is none."""
    lead = F.regexp_extract(trimmed(c), r"\A(,*\d[\d,]*(?:\s+,*\d[\d,]*)*)(?=\s|\z)", 1)
    numbers = F.transform(F.split(lead, r"\s+"), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("long"))
    return F.when(lead != "", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(numbers, i), F.lit(0).cast("long"))))


def copy_time(c: Column | str) -> Column:
    """Time without zone of a text such as Monday, January 01, 2024 10:00:00 AM; NULL if unreadable. The day's name isn't compared with the date."""
    rest = F.regexp_extract(trimmed(c), r"\A(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,\s+([A-Za-z]+\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}:\d{2}\s+[AaPp][Mm])\z", 1)
    plain = F.upper(F.regexp_replace(rest, r"\s+", " "))
    name = F.initcap(F.substring_index(plain, " ", 1))
    return F.try_to_timestamp(F.when(rest != "", F.concat(name, F.substring(plain, F.length(name) + 1, F.length(plain)))), F.lit("MMMM d, yyyy h:mm:ss a")).cast("timestamp_ntz")


def eta_seconds(done: Column | str, total: Column | str, elapsed: Column | str) -> Column:
    """Seconds that are left at the rate so far; NULL if nothing is done, nothing is left, or no time has passed."""
    d, t, e = as_column(done), as_column(total), as_column(elapsed)
    return F.when((d > 0) & (t > d) & (e > 0), ((t - d) / (d / e)).cast("long"))
