"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.text import has_code, path_key, root_key
from ..session import settled
from .common import small_join, take


def row_hash(*columns: Column) -> Column:
    """Hash of a row's values that tells NULL from every value and from its place (xxhash64 itself skips NULLs)."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def diff(before: DataFrame, after: DataFrame, keys: list[str], same: Column | None = None) -> DataFrame:
    """Rows added, removed or changed between two snapshots with unique, non-NULL keys and a column row_hash.

    One full outer join on the keys: a missing side is an addition or a removal, unequal hashes a change.
    same: a condition on the sides' columns (before_x, after_x) under which unequal hashes still mean no change.
    Gives the keys and `change`; equal rows give nothing, empty snapshots on both sides give no rows.
    """
    old = before.select(*keys, *(F.col(c).alias(f"before_{c}") for c in before.columns if c not in keys), F.lit(True).alias("_before"))
    new = after.select(*keys, *(F.col(c).alias(f"after_{c}") for c in after.columns if c not in keys), F.lit(True).alias("_after"))
    changed = F.col("before_row_hash") != F.col("after_row_hash")
    if same is not None:
        changed = changed & ~F.coalesce(same, F.lit(False))
    kind = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(changed, "changed")
    return old.join(new, keys, "full_outer").select(*keys, kind.alias("change")).where(F.col("change").isNotNull())


def consecutive_runs(files: DataFrame, scans: DataFrame) -> DataFrame:
    """scan_run_id and previous_run_id of the runs of a root in the order of started_at (ties by id), without runs that have no rows in files.

    A run with an unreadable started_at comes before all others of its root. scans has few rows a root; the window runs over scans alone.
    """
    present = take(files, "scan_run_id").distinct()
    runs = take(scans, "scan_run_id", "started_at", "root_path").where(F.col("scan_run_id").isNotNull() & F.col("root_path").isNotNull())
    runs = runs.groupBy("scan_run_id").agg(F.max("started_at").alias("started_at"), F.max("root_path").alias("root_path"))
    order = Window.partitionBy("root").orderBy("at", "scan_run_id")
    return (
        runs.join(present, "scan_run_id", "left_semi")
        .select("scan_run_id", root_key("root_path").alias("root"), instant_micros("started_at").alias("at"))
        .withColumn("previous_run_id", F.lag("scan_run_id").over(order))
        .where(F.col("previous_run_id").isNotNull())
        .select("scan_run_id", "previous_run_id")
    )


def run_changes(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Paths that each scan run added, removed or changed against the run of the same root before it.

    Gives scan_run_id (the later run), path_key (the path in lower case) and change. Of a path listed more
    than once in a run the row with the highest file_id counts (a NULL id is the lowest). Changed: size_bytes
    differs, or both mtime_utc are readable and differ; not if either row's error_code holds the code process.
    Rows with a NULL path or run, and runs not in scans, give nothing; nor does the first run of a root.

    The plan: each side is pre-aggregated and shuffled once, on the later run's id and the path; the full
    outer join needs no further exchange. Runs meet files by a broadcast whose rows are counted first.
    """
    pairs = settled(consecutive_runs(files, scans))
    rows = take(files, "file_id", "scan_run_id", "path_abs", "size_bytes", "mtime_utc", "error_code").where(F.col("path_abs").isNotNull())

    def side(run: str) -> DataFrame:
        names = pairs.select(F.col(run).alias("scan_run_id"), F.col("scan_run_id").alias("later_run_id"))
        own = small_join(rows, names, ["scan_run_id"]).select(
            "later_run_id",
            path_key("path_abs").alias("path_key"),
            F.coalesce("file_id", F.lit(-(2**63))).alias("file_id"),
            "size_bytes",
            instant_micros("mtime_utc").alias("mtime"),
            has_code("error_code", "process").alias("unknown"),
        )
        # one struct, so that rows with the same id never mix their values
        latest = own.groupBy("later_run_id", "path_key").agg(F.max(F.struct("file_id", "size_bytes", "mtime", "unknown")).alias("r"))
        latest = latest.select("later_run_id", "path_key", "r.size_bytes", "r.mtime", "r.unknown")
        return latest.withColumn("row_hash", row_hash(F.col("size_bytes"), F.col("mtime")))

    size_kept = F.col("before_size_bytes").eqNullSafe(F.col("after_size_bytes"))
    time_kept = F.coalesce(F.col("before_mtime") == F.col("after_mtime"), F.lit(True))
    same = F.col("before_unknown") | F.col("after_unknown") | (size_kept & time_kept)
    changes = diff(side("previous_run_id"), side("scan_run_id"), ["later_run_id", "path_key"], same)
    return changes.select(F.col("later_run_id").alias("scan_run_id"), "path_key", "change")
