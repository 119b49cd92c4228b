"""Counts over the catalog: states, digests, and the work that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prefix_filter
from ..functions.text import ext_key
from . import groups

MIB = 1024 * 1024
# Names and upper bounds of the size buckets, each from the bound before it.
BUCKETS = [("< 1 MB", MIB), ("1-10 MB", 10 * MIB), ("10-100 MB", 100 * MIB), ("100-500 MB", 500 * MIB), ("500 MB - 1 GB", 1024 * MIB), ("> 1 GB", None)]


def status_counts(files: DataFrame) -> DataFrame:
    """One row: total, done, pending (pending, quick_hashed, sha_pending) and errors, from one pass; zeros for an empty catalog."""
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state").isin("pending", "quick_hashed", "sha_pending")).alias("pending"),
        F.count_if(F.col("state") == "error").alias("errors"),
    )


def state_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def distinct_states(files: DataFrame) -> DataFrame:
    return files.select("state").where(F.col("state").isNotNull()).distinct()


def digest_coverage(files: DataFrame) -> DataFrame:
    """One row: rows with sha256, done, in progress, and the sha256 that occur more than once (their number is also that of unique hashes among them)."""
    dup = groups.repeated(files, "sha256").agg(F.count(F.lit(1)).alias("n"))
    return files.agg(
        F.count("sha256").alias("with_sha"),
        F.count_if(F.col("state") == "done").alias("done"),
        F.count_if(F.col("state").isin("quick_hashed", "sha_verified")).alias("in_progress"),
    ).select("*", dup.scalar().alias("dup_groups"), dup.scalar().alias("unique_hashes"))


def _unhashed(files: DataFrame, prefix: str) -> DataFrame:
    rows = groups.active(files).where(F.col("sha256").isNull())
    return rows.where(prefix_filter("path_abs", [prefix])) if prefix else rows


def _sizes() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        F.count(F.lit(1)).alias("files"),
        zero(F.sum("size_bytes")).alias("total_bytes"),
        F.coalesce(F.avg("size_bytes"), F.lit(0.0)).alias("avg_bytes"),
        zero(F.min("size_bytes")).alias("min_bytes"),
        zero(F.max("size_bytes")).alias("max_bytes"),
    ]


def workload_unhashed(files: DataFrame, prefix: str = "S:") -> DataFrame:
    """One row over active files without sha256 below a prefix ('' for all): files, total, avg, min and max bytes."""
    return _unhashed(files, prefix).agg(*_sizes())


def workload_candidates(files: DataFrame, prefix: str = "S:", min_size: int = 1024, min_count: int = 2) -> DataFrame:
    """One row over the unhashed files that share size and extension with another file below the prefix: files, total_bytes, avg_bytes."""
    scope = groups.active(files).where(prefix_filter("path_abs", [prefix])) if prefix else groups.active(files)
    return groups.in_size_ext_groups(_unhashed(files, prefix), scope, min_size, min_count).agg(*_sizes()[:3])


def size_bucket(c: str = "size_bytes", buckets: list[tuple[str, int | None]] | None = None) -> Column:
    """Name of the half-open bucket that a size lies in."""
    buckets = buckets or BUCKETS
    out = F.lit(buckets[-1][0])
    for name, bound in reversed(buckets[:-1]):
        out = F.when(F.col(c) < bound, name).otherwise(out)
    return out


def size_buckets(files: DataFrame, prefix: str = "S:", buckets: list[tuple[str, int | None]] | None = None) -> DataFrame:
    """bucket, n, bytes of the unhashed files, in one pass; empty buckets give no row."""
    rows = _unhashed(files, prefix).where(F.col("size_bytes") >= 0)
    return rows.groupBy(size_bucket("size_bytes", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def workload_estimate(files: DataFrame, prefix: str = "S:", network_mib: int = 100, local_mib: int = 500, workers: int = 8) -> DataFrame:
    """One row: bytes of the candidates, and the seconds to read them over the network and locally, alone and with workers."""
    b = F.col("total_bytes").cast("double")
    return workload_candidates(files, prefix).select(
        "total_bytes",
        (b / (network_mib * MIB)).alias("network_seconds"),
        (b / (local_mib * MIB)).alias("local_seconds"),
        (b / (network_mib * MIB) / workers).alias("network_seconds_parallel"),
        (b / (local_mib * MIB) / workers).alias("local_seconds_parallel"),
    )


def progressive_savings(files: DataFrame, prefix: str = "S:", sample: int = 65_536, network_mib: int = 100, workers: int = 8) -> DataFrame:
    """One row: what sampling large files instead of reading them whole would save. The large files are all unhashed ones over 1 MiB, so savings may be negative; the time is in seconds."""
    large = _unhashed(files, prefix).where(F.col("size_bytes") > MIB).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
    n, b = large.select("n").scalar(), large.select("b").scalar()
    out = workload_candidates(files, prefix).select(F.col("total_bytes").alias("dup_bytes"), n.alias("large_files"), b.alias("large_bytes"))
    out = out.withColumn("progressive_bytes", F.col("large_files") * sample + F.col("dup_bytes") - F.col("large_bytes"))
    return out.select(
        "*",
        (F.col("dup_bytes") - F.col("progressive_bytes")).alias("savings_bytes"),
        (F.col("progressive_bytes") / float(network_mib * MIB) / workers).alias("progressive_seconds"),
    )


def extension_summary(files: DataFrame, samples: int = 3, top: int | None = None) -> DataFrame:
    """ext (NULL as empty), n, and up to `samples` lowest distinct names; top: only the extensions with most files, ties by name. Names are reduced by a window whose limit is applied before the shuffle."""
    keyed = files.select(groups.ext_or_empty().alias("ext"), "name")
    counts = keyed.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), "ext").limit(top)
    names = keyed.where(F.col("name").isNotNull()).distinct()
    first = groups.first_members(names, ["ext"], [F.asc("name")], samples)
    lists = first.groupBy("ext").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    empty = F.array().cast("array<string>")
    return counts.join(lists, "ext", "left").select("ext", "n", F.coalesce("samples", empty).alias("samples"))


# What kinds of files the categorized summary tells apart; others are in none.
CATEGORIES = {
    "documents": [".pdf", ".doc", ".docx", ".txt", ".rtf", ".odt", ".md"],
    "sheets": [".xls", ".xlsx", ".csv", ".ods"],
    "drawings": [".dwg", ".dxf", ".rvt", ".skp"],
    "images": [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".gif", ".bmp"],
    "mail": [".msg", ".eml", ".pst"],
    "archives": [".zip", ".7z", ".rar", ".tar", ".gz"],
}


def extension_categories(files: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """category, extensions and n of the files by kind of extension (trimmed, without case); other for the rest."""
    counts = files.groupBy(ext_key("ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    category = F.lit("other")
    for name, exts in (CATEGORIES if categories is None else categories).items():
        category = F.when(F.col("ext").isin([e.lower() for e in exts]), name).otherwise(category)
    return counts.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("extensions"), F.sum("n").alias("n"))
