"""Logs, headers and manifests of the copy tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import copy_time, format_bytes, parse_human_size, summary_values
from ..functions.paths import like, quoted, relative_to
from ..functions.text import trimmed
from ..session import settled
from . import groups
from .skew import balanced_rank

# The log's counters in the order of its columns, after the total; the copy command's options.
COUNTERS = ["copied", "skipped", "mismatch", "failed", "extras"]
OPTIONS = "/MT:{threads} /R:2 /W:5 /NFL /NDL /NP /BYTES /TEE /LOG+:{log}"


def _after_colon(line: Column) -> Column:
    return F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Each line (trimmed; blank and NULL ones dropped) with what it says: started, files and bytes (arrays of total, copied, skipped, mismatch, failed, extras), and last_file for a files line without numbers."""
    line = trimmed("line")
    rows = lines.withColumn("line", line).where(F.col("line") != "")
    is_files, is_bytes = F.col("line").startswith("Files :"), F.col("line").startswith("Bytes :")
    payload = trimmed(_after_colon(F.col("line")))
    numbers = summary_values(payload)
    return rows.select(
        "*",
        F.when(F.col("line").startswith("Started :"), copy_time(payload)).alias("started"),
        F.col("line").startswith("Started :").alias("is_start"),
        F.when(is_files, numbers).alias("files"),
        F.when(is_bytes, numbers).alias("bytes"),
        F.when(is_files & numbers.isNull() & (payload != ""), payload).alias("last_file"),
    )


def _status(files: Column) -> Column:
    names = [("copied", 1), ("skipped", 2), ("failed", 4), ("mismatch", 3), ("extra", 5)]
    out = F.lit(None).cast("string")
    for name, k in reversed(names):
        out = F.when(F.get(files, F.lit(k)) > 0, name).otherwise(out)
    return out


def summary(lines: DataFrame, keys: list[str] | None = None, position: str = "line_no") -> DataFrame:
    """Sums of a log, or of each log by keys: blocks, five counters of files and six of bytes, first start, last start, last file and last status by position.

    Everything is combined before the shuffle; a long log is no longer task. A log without lines gives no row with keys, and one row of zeros
    without.
    """
    p = parsed_lines(lines).withColumn("status", _status(F.col("files")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    at = F.col(position)
    aggs = [
        F.count("files").alias("blocks"),
        *(zero(F.get("files", F.lit(k + 1))).alias(c) for k, c in enumerate(COUNTERS)),
        *(zero(F.get("bytes", F.lit(k))).alias(f"bytes_{c}") for k, c in enumerate(["total", *COUNTERS])),
        F.min_by("started", F.when(F.col("started").isNotNull(), at)).alias("start_time"),
        F.max_by("started", F.when(F.col("is_start"), at)).alias("last_start"),
        F.max_by("last_file", F.when(F.col("last_file").isNotNull(), at)).alias("last_file"),
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("last_status"),
    ]
    return p.groupBy(*keys).agg(*aggs) if keys else p.agg(*aggs)


def header(lines: DataFrame, position: str = "line_no") -> DataFrame:
    """One row of a copy script's header: total_files and total_bytes, each from its last readable REM line; NULL if there is none."""
    line = trimmed("line")
    upper = F.upper(line)
    number = F.regexp_replace(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1), r"[^0-9]", "").try_cast("long")
    size = parse_human_size(_after_colon(line))
    files = F.when(upper.startswith("REM TOTAL FILES:"), number)
    total = F.when(upper.startswith("REM TOTAL SIZE:") & (size != 0), size)
    at = F.col(position)
    return lines.agg(F.max_by(files, F.when(files.isNotNull(), at)).alias("total_files"), F.max_by(total, F.when(total.isNotNull(), at)).alias("total_bytes"))


def manifest(files: DataFrame, prefix: str) -> DataFrame:
    """dir and name of the active files to copy below a prefix."""
    own = prefix + "%"
    return groups.active(files).where(like("dir", own) & like("path_abs", own)).select("dir", "name")


def manifest_counts(files: DataFrame, prefix: str) -> DataFrame:
    """dir, files and first and last name of the manifest."""
    return manifest(files, prefix).groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def script_lines(files: DataFrame, prefix: str, target: str, log: str = "copy.log", threads: int = 16) -> DataFrame:
    """dir, name and line: one copy command for each file of the manifest. Ordering and numbering are left to the writer, so lines are made in parallel."""
    m = manifest(files, prefix)
    rest = F.substring("dir", len(prefix) + 1, 2**31 - 1)
    dest = F.when(rest == "", F.lit(target)).otherwise(F.concat(F.lit(target + "\\"), rest))
    options = F.lit(" " + OPTIONS.format(threads=threads, log=log))
    line = F.concat(F.lit('robocopy "'), quoted("dir"), F.lit('" "'), quoted(dest), F.lit('" "'), quoted("name"), F.lit('"'), options)
    return m.select("dir", "name", relative_to("dir", prefix).alias("display"), line.alias("line"))


def script(files: DataFrame, prefix: str, target: str, log: str = "copy.log", threads: int = 16) -> DataFrame:
    """The whole copy script: part, dir, kind, name and line, whose order is that of the first four. header() reads its head again.

    Part 0 is the head with the totals, part 1 the directories, each with an echo of its number, its commands and an empty echo, part 2 the foot. Directories are
    numbered in range partitions, so their number has no bound.
    """
    commands = settled(script_lines(files, prefix, target, log, threads))
    total = groups.active(files).where(like("dir", prefix + "%") & like("path_abs", prefix + "%")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
    dirs = settled(balanced_rank(commands.groupBy("dir").agg(F.first("display").alias("display")).withColumn("_all", F.lit(1)), ["_all"], [F.asc("dir")], "idx"))
    n = dirs.agg(F.count(F.lit(1)).alias("n"))
    row = lambda part, kind, line, of="": F.struct(F.lit(part).alias("part"), F.lit(of).alias("dir") if of == "" else F.col(of).alias("dir"), F.lit(kind).alias("kind"), F.lit("").alias("name"), line.alias("line"))
    # What a batch file of the copy tool begins and ends with.
    head = [
        F.lit("@echo off"), F.lit(f"REM Source: {prefix}"), F.lit(f"REM Destination: {target}"),
        F.concat(F.lit("REM Total files: "), F.format_number("n", 0)), F.concat(F.lit("REM Total size: "), format_bytes("b", 2)), F.lit(f"REM Threads: {threads}"),
    ]
    foot = [F.lit("echo Copy complete."), F.lit("pause")]
    ends = total.select(F.explode(F.array(*(row(0, k, x) for k, x in enumerate(head)), *(row(2, k, x) for k, x in enumerate(foot)))).alias("r")).select("r.*")
    number = F.concat(F.lit("echo "), F.col("idx").cast("string"), F.lit("/"), n.scalar().cast("string"), F.lit(": "), F.col("display"))
    around = dirs.select(F.explode(F.array(row(1, 0, number, "dir"), row(1, 2, F.lit("echo."), "dir"))).alias("r")).select("r.*")
    own = commands.select(F.lit(1).alias("part"), "dir", F.lit(1).alias("kind"), "name", "line")
    return ends.unionByName(around).unionByName(own)


def write_script(files: DataFrame, prefix: str, target: str, path: str, **options) -> None:
    """Writes the script as text files; each part file holds a range of directories, and their names rise with it."""
    by = ["part", "dir", "kind", "name"]
    settled(script(files, prefix, target, **options)).repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.mode("overwrite").text(path)
