"""Groups of files that may be, or are, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.paths import prefix_filter
from ..functions.text import path_key
from ..session import settled
from .common import small_join, take


def active(df: DataFrame) -> DataFrame:
    """Rows whose state, as it is spelled, is neither error nor missing; a NULL state isn't active."""
    return df.where(~F.col("state").isin("error", "missing"))


def ext_or_empty(c: str = "ext") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def first_members(rows: DataFrame, keys: list[str], order: list[Column], most: int = 3) -> DataFrame:
    """The first `most` members of each group, with their place. The window's limit is applied before the shuffle, so a group of any size sends few rows."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def run_starts(scans: DataFrame) -> DataFrame:
    """scan_run_id, once each, and run_at, when the run started in microseconds since 1970; NULL if that can't be read."""
    runs = take(scans, "scan_run_id", "started_at").where(F.col("scan_run_id").isNotNull())
    return settled(runs.groupBy("scan_run_id").agg(F.max(instant_micros("started_at")).alias("run_at")))


def latest_per_path(files: DataFrame, scans: DataFrame, ties: Sequence[Column] = ()) -> DataFrame:
    """One row a path, compared in lower case: that of its latest run by started_at, in it that of the highest id. A path that was listed twice is no duplicate of itself, however it is spelled.

    Runs that start at one time count by id; a run that isn't in scans or whose start can't be read comes before all others. Rows without a path are
    kept, as none of them repeats another. ties: what decides beyond that. A path of any number of rows sends one row a task.
    """
    placed = small_join(files.where(F.col("path_abs").isNotNull()), run_starts(scans), ["scan_run_id"], "left").withColumn("_path", path_key("path_abs"))
    order = [F.desc_nulls_last("run_at"), F.desc_nulls_last("scan_run_id"), F.desc_nulls_last("file_id"), *ties]
    return files.where(F.col("path_abs").isNull()).unionByName(first_members(placed, ["_path"], order, 1).select(*files.columns))


def size_ext_groups(files: DataFrame, min_size: int, min_count: int) -> DataFrame:
    """size_bytes, ext (NULL as empty) and cnt of the groups of active files of at least min_size with at least min_count members."""
    rows = active(files).where(F.col("size_bytes") >= min_size)
    return rows.groupBy("size_bytes", ext_or_empty().alias("ext")).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)


def members(rows: DataFrame, groups: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose keys form a group: a semi-join to unique keys, so nothing is multiplied and Spark may broadcast the keys if they are small."""
    tagged = rows.withColumns({f"_{k}": c for k, c in keys.items()})
    wanted = groups.select(*(F.col(k).alias(f"_{k}") for k in keys))
    return tagged.join(wanted, [f"_{k}" for k in keys], "left_semi").select(*rows.columns)


def in_size_ext_groups(rows: DataFrame, files: DataFrame, min_size: int, min_count: int) -> DataFrame:
    """Rows in a group of size and extension that is formed over all files, whatever filter the rows have passed."""
    return members(rows, size_ext_groups(files, min_size, min_count), {"size_bytes": F.col("size_bytes"), "ext": ext_or_empty()})


def scope_counts(files: DataFrame, min_size: int, min_count: int) -> DataFrame:
    """One row: active files, files in groups of size and extension, the groups, and the active files outside of them (0 at least)."""
    groups = size_ext_groups(files, min_size, min_count)
    found = groups.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("duplicate_population"), F.count(F.lit(1)).alias("duplicate_groups"))
    total = active(files).agg(F.count(F.lit(1)).alias("n"))
    return found.select(
        total.scalar().alias("total_active"),
        "duplicate_population",
        "duplicate_groups",
        F.greatest(F.lit(0), total.scalar() - F.col("duplicate_population")).cast("long").alias("skipped_singletons"),
    )


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys without NULL that occur more than once, with cnt."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out


def digest_columns(files: DataFrame) -> list[str]:
    return [c for c in ("sha256", "blake3") if c in files.columns]


def digested(files: DataFrame) -> DataFrame:
    """Adds `_digest`, the algorithm and digest that a file is grouped by: its sha256, else its blake3; NULL without either. Then only one of both columns is set.

    A file with blake3 alone takes the sha256 of a file with that blake3, if there is one, as their contents are the same. An empty
    blake3 is none. Tables without the column blake3 are grouped by sha256.
    """
    if "blake3" not in files.columns:
        return files.withColumn("_digest", F.col("sha256"))
    own, known = F.nullif(F.col("blake3"), F.lit("")), F.col("sha256").isNotNull()
    peers = files.where(known & own.isNotNull()).groupBy(own.alias("_blake3")).agg(F.min("sha256").alias("_sha256"))
    # rows with a sha256 match nothing; a key of their own keeps them from meeting in one partition
    rows = files.withColumn("_blake3", F.when(~known, own)).withColumn("_key", F.coalesce("_blake3", F.concat(F.lit("?"), "file_id")))
    rows = rows.join(peers.withColumnRenamed("_blake3", "_key"), "_key", "left").drop("_key")
    rows = rows.withColumn("sha256", F.coalesce("sha256", "_sha256")).withColumn("blake3", F.when(~known, F.col("_blake3"))).drop("_blake3", "_sha256")
    return rows.withColumn("_digest", F.coalesce(F.concat(F.lit("sha256:"), "sha256"), F.concat(F.lit("blake3:"), "blake3")))


def sha_groups(files: DataFrame) -> DataFrame:
    """sha256, blake3 (one of them NULL), cnt and total_size of the digests that several active files share."""
    rows = active(digested(files)).where(F.col("_digest").isNotNull())
    return rows.groupBy(*digest_columns(files)).agg(F.count(F.lit(1)).alias("cnt"), F.sum("size_bytes").alias("total_size")).where(F.col("cnt") > 1)


def duplicate_summary(files: DataFrame) -> DataFrame:
    """One row: groups, files in them, and bytes that one file a group would save."""
    g = sha_groups(files)
    total = F.col("total_size").cast("double")
    return g.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(total - total / F.col("cnt")), F.lit(0.0)).alias("wasted_bytes"),
    )


def metadata_groups(files: DataFrame, min_size: int, min_count: int, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Groups by size, lower-case name and extension, without reading contents: size_bytes, name_key, ext_key, cnt."""
    rows = active(files).where((F.col("size_bytes") >= min_size) & prefix_filter("path_abs", include, exclude))
    return (
        rows.groupBy("size_bytes", F.lower("name").alias("name_key"), ext_or_empty().alias("ext_key"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where((F.col("cnt") >= min_count) & F.col("name_key").isNotNull())
    )


def metadata_rows(files: DataFrame, min_size: int, min_count: int, include: Sequence[str] = (), exclude: Sequence[str] = (), compatible: bool = False) -> DataFrame:
    """Members of the metadata groups. compatible: also members outside of the path filter, which then only picks the groups."""
    groups = metadata_groups(files, min_size, min_count, include, exclude)
    rows = active(files)
    if not compatible:
        rows = rows.where((F.col("size_bytes") >= min_size) & prefix_filter("path_abs", include, exclude))
    return members(rows, groups, {"size_bytes": F.col("size_bytes"), "name_key": F.lower("name"), "ext_key": ext_or_empty()})


def metadata_wasted(groups: DataFrame) -> DataFrame:
    """One row: bytes in all but one member of each metadata group."""
    return groups.agg(F.coalesce(F.sum(F.col("size_bytes") * (F.col("cnt") - 1)), F.lit(0)).alias("wasted_bytes"))


def duplicate_report(files: DataFrame, limit: int = 100, include: Sequence[str] = (), exclude: Sequence[str] = (), compatible: bool = False) -> DataFrame:
    """The `limit` groups of equal digests that waste most, one row a member: rank, sha256, blake3 (one of them NULL), cnt, size_bytes, total_wasted, file_id, path_abs, mtime_utc.

    Ranked by size times (count - 1), ties by digest. Members are the active files of the group; compatible: all of its
    files, so that there can be more of them than cnt. At most `limit` groups are broadcast to the files.
    """
    keys = digest_columns(files)
    files = digested(files).where(prefix_filter("path_abs", include, exclude))
    rows = active(files).where(F.col("_digest").isNotNull())
    g = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("cnt"), F.min("size_bytes").alias("size_bytes")).where(F.col("cnt") > 1)
    g = g.withColumn("total_wasted", F.col("size_bytes") * (F.col("cnt") - 1)).orderBy(F.desc("total_wasted"), "_digest").limit(limit)
    # numbered over the few rows that the limit leaves
    top = g.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("total_wasted")).alias("w"), "_digest", "cnt", "size_bytes"))).alias("a"))
    top = top.select(F.posexplode("a").alias("i", "g")).select((F.col("i") + 1).alias("rank"), "g._digest", "g.cnt", F.col("g.size_bytes").alias("size_bytes"), (-F.col("g.w")).alias("total_wasted"))
    own = (files if compatible else active(files)).where(F.col("_digest").isNotNull()).select("_digest", *keys, "file_id", "path_abs", "mtime_utc")
    return own.join(F.broadcast(top), "_digest").select("rank", *keys, "cnt", "size_bytes", "total_wasted", "file_id", "path_abs", "mtime_utc")
