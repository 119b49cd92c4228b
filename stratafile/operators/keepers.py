"""Which copy of a duplicate stays, and which go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.paths import prefix_filter
from ..functions.text import path_key
from ..session import arrow_map, settled
from . import groups
from .common import lookup_join
from .skew import balanced_rank


def mtime_micros(c: Column | str = "mtime_utc") -> Column:
    """The time of a file; what is empty or can't be read counts as 1970, hence as oldest."""
    return F.coalesce(instant_micros(c), F.lit(0).cast("long"))


def prune_plan(files: DataFrame, scans: DataFrame, strategy: str = "oldest", include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Of each digest that several active files share: sha256, blake3 (one of them NULL), file_id, path_abs, size_bytes, rank and role (keep or remove).

    Rank 1 is kept: the oldest or newest by mtime, ties by lower-case path, then id. A path that was listed several times, in
    whatever case, counts once, by its latest row (groups.latest_per_path), so nothing is planned that would remove a keeper's own path; rows without
    a path have no part. Ranks are numbered by balanced_rank: a digest that a third of all files share is spread like any other rows.
    """
    if strategy not in ("oldest", "newest"):
        raise ValueError(f"strategy must be oldest or newest, not {strategy}")
    rows = groups.active(groups.latest_per_path(groups.digested(files), scans)).where(F.col("_digest").isNotNull() & F.col("path_abs").isNotNull() & prefix_filter("path_abs", include, exclude))
    keys = groups.digest_columns(files)
    rows = settled(rows.select("_digest", *keys, "file_id", "path_abs", "size_bytes", mtime_micros().alias("_mtime"), path_key("path_abs").alias("_path")))
    shared = groups.repeated(rows, "_digest").select("_digest", F.lit(True).alias("_shared"))
    rows = lookup_join(rows, shared, ["_digest"]).drop("_shared")
    time = F.asc("_mtime") if strategy == "oldest" else F.desc("_mtime")
    ranked = balanced_rank(rows, ["_digest"], [time, F.asc("_path"), F.asc("file_id")])
    role = F.when(F.col("rank") == 1, "keep").otherwise("remove")
    return ranked.select(*keys, "file_id", "path_abs", "size_bytes", "rank", role.alias("role"))


def prune_stats(plan: DataFrame) -> DataFrame:
    """One row over a plan: its groups, the groups that lose files, the files to remove, and their bytes."""
    gone = F.col("role") == "remove"
    return plan.agg(
        F.count_if(~gone).alias("hash_groups"),
        F.count_if(F.col("rank") == 2).alias("groups_modified"),
        F.count_if(gone).alias("files_considered"),
        F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("potential_bytes"),
    )


def plan_safety(plan: DataFrame) -> DataFrame:
    """One row over a plan: kept and removed files, and how many of the removed have the path of a kept one or of another removed one, compared in lower case; 0 in any plan that may be carried out."""
    paths = plan.groupBy(path_key("path_abs").alias("_path")).agg(F.count_if(F.col("role") == "keep").alias("k"), F.count_if(F.col("role") == "remove").alias("r"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return paths.agg(n("k").alias("kept"), n("r").alias("removed"), n(F.when(F.col("k") + F.col("r") > 1, F.col("r")).otherwise(0)).alias("unsafe"))


def metadata_prune(files: DataFrame, scans: DataFrame, min_size: int, min_count: int, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """file_id of all but the oldest member of each metadata group (size, lower-case name and extension), over the latest row of each path."""
    rows = groups.metadata_rows(groups.latest_per_path(files, scans), min_size, min_count, include, exclude).select(
        "file_id", "size_bytes", F.lower("name").alias("_name"), F.lower(groups.ext_or_empty()).alias("_ext"), mtime_micros().alias("_mtime"), path_key("path_abs").alias("_path")
    )
    ranked = balanced_rank(rows, ["size_bytes", "_name", "_ext"], [F.asc("_mtime"), F.asc("_path"), F.asc("file_id")])
    return ranked.where(F.col("rank") > 1).select("file_id")


def execute_plan(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Unlinks the files that a plan removes, where they lie, and gives each one's outcome: removed, missing, error or, in a dry run, planned.

    Never done unless asked for. A path that a keeper of the plan has, in whatever case, is skipped.
    """
    import pyarrow as pa

    def run(batches):
        import os

        for batch in batches:
            out = []
            for path in batch.column("path_abs").to_pylist():
                try:
                    if not dry_run:
                        os.unlink(path)
                    out.append("planned" if dry_run else "removed")
                except FileNotFoundError:
                    out.append("missing")
                except OSError:
                    out.append("error")
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(out, pa.string())], names=["file_id", "outcome"])

    keyed = plan.select("role", "file_id", "path_abs", path_key("path_abs").alias("_path"))
    kept = keyed.where(F.col("role") == "keep").select("_path")
    gone = keyed.where(F.col("role") == "remove").join(kept, "_path", "left_anti").select("file_id", "path_abs")
    return arrow_map(gone, run, "file_id long, outcome string")
