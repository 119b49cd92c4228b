"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.text import is_active, path_key, valid_sha256
from ..operators.common import take
from ..operators.groups import latest_per_path


def top_of_group(rows: DataFrame, keys: list[str], order: list[Column], least: int = 1) -> DataFrame:
    """The first row of each group in a total order, of groups with at least `least` rows (1 or 2).

    Ranked by a window whose limit Spark also applies before the shuffle, so that of a group of any size
    each task sends on at most `least` rows. Rows with a NULL key form a group like others.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= least)
    if least > 1:
        ranked = ranked.withColumn("_last", F.max("_rank").over(Window.partitionBy(*keys))).where(F.col("_last") == least).drop("_last")
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def latest_listings(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Of all rows of a path (in lower case) the one of its latest run by started_at, in it the one with the highest file_id.

    Runs that start at one time count by id; a run that isn't in scans or whose start is unreadable comes first.
    """
    rows = take(files, "file_id", "scan_run_id", "path_abs", "sha256", "size_bytes", "mtime_utc", "state", "last_seen_at")
    seen, mtime = instant_micros("last_seen_at"), instant_micros("mtime_utc")
    rows = rows.where(F.col("path_abs").isNotNull()).select(
        "file_id",
        "scan_run_id",
        path_key("path_abs").alias("path_abs"),
        F.when(is_active("state") & (F.col("size_bytes") > 0), valid_sha256("sha256")).alias("sha256"),
        F.when(mtime <= seen, mtime).alias("trusted"),
    )
    latest = latest_per_path(rows, scans, [F.desc_nulls_last("sha256"), F.desc_nulls_last("trusted")])
    return latest.where(F.col("path_abs").isNotNull()).withColumnRenamed("path_abs", "path_key")


def copies_to_keep(files: DataFrame, scans: DataFrame) -> DataFrame:
    """For each content under several paths, the copy to keep: sha256, file_id.

    Only the latest row of each path counts; the active ones of size over 0 with a valid sha256 form groups,
    and groups of two or more give a row. Trust: mtime_utc is readable and not after last_seen_at
    (an unreadable last_seen_at vouches for nothing). Kept is the row with the latest trusted time, those
    without one last, on ties the lowest path in lower case by code points. Rows without a path don't count.
    """
    rows = latest_listings(files, scans).where(F.col("sha256").isNotNull()).select("sha256", "file_id", "path_key", "trusted")
    return top_of_group(rows, ["sha256"], [F.desc_nulls_last("trusted"), F.asc("path_key"), F.asc("file_id")], least=2).select("sha256", "file_id")
