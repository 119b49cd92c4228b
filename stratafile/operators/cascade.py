"""The cascade from cheap to dear: size and extension, sampled digests, whole digests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import hash_files
from ..functions.paths import prefix_filter
from ..schema import CatalogConfig
from ..session import settled
from . import groups, transitions


@dataclass
class Scope:
    """Which files a run of the cascade is about."""

    min_size: int = 262_144
    min_count: int = 5
    small: int = 131_072
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()

    @classmethod
    def of(cls, config: CatalogConfig, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Scope:
        d = config.dedupe
        return cls(d.min_file_size, d.min_duplicate_count, d.small_file_threshold, include, exclude)


def quick_hash_candidates(files: DataFrame, scope: Scope) -> DataFrame:
    """Active files without a quick hash, of at least the least size, under the path filter, in a group of size and extension. The groups are formed without the path filter."""
    rows = groups.active(files).where(F.col("quick_hash").isNull() & (F.col("size_bytes") >= scope.min_size) & prefix_filter("path_abs", scope.include, scope.exclude))
    return groups.in_size_ext_groups(rows, files, scope.min_size, scope.min_count).select("file_id", "path_abs", "size_bytes")


def _without_sha(files: DataFrame, scope: Scope, digest: str = "sha256") -> DataFrame:
    missing = F.col("sha256").isNull() if digest == "sha256" else F.coalesce(digest, F.lit("")) == ""
    rows = groups.active(files).where(missing & prefix_filter("path_abs", scope.include, scope.exclude))
    return groups.in_size_ext_groups(rows, files, scope.min_size, scope.min_count)


def sha_candidates(files: DataFrame, scope: Scope, network_friendly: bool = False, digest: str = "sha256") -> DataFrame:
    """Active files without the whole digest in a group of size and extension, whose quick hash occurs more than once among all files (inactive ones too); unless network_friendly also those under the small-file limit without a quick hash."""
    rows = _without_sha(files, scope, digest)
    twice = groups.repeated(files, "quick_hash").select(F.col("quick_hash").alias("_key"), F.lit(True).alias("_twice"))
    # rows without a quick hash match nothing; a key of their own keeps them from meeting in one partition
    flagged = rows.withColumn("_key", F.coalesce("quick_hash", F.concat(F.lit("?"), F.col("file_id")))).join(twice, "_key", "left")
    keep = F.col("_twice").isNotNull()
    if not network_friendly:
        keep = keep | ((F.col("size_bytes") < scope.small) & F.col("quick_hash").isNull() & (F.col("size_bytes") >= scope.min_size))
    return flagged.where(keep).select("file_id", "path_abs", "size_bytes", "quick_hash")


def collisions(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that share all keys, none of them NULL, with another row."""
    return groups.members(rows, groups.repeated(rows, *keys), {k: F.col(k) for k in keys})


def progressive_candidates(files: DataFrame, scope: Scope, digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Candidates whose head digest h1 collides within a size, and of those the ones whose tail digest h2 collides too. The extension has no part in it."""
    heads = collisions(_without_sha(files, scope, digest).select("file_id", "path_abs", "size_bytes", "h1", "h2"), "size_bytes", "h1")
    return heads, collisions(heads, "size_bytes", "h1", "h2")


#: Called as a run goes on, with the stage, how many files of it are done, how many there are, and a message.
Progress = Callable[[str, int, int, str], None]


def detect_changes(
    files: DataFrame,
    config: CatalogConfig,
    *,
    quick_hash: bool = True,
    sha256: bool = True,
    network_friendly: bool = False,
    progressive: bool = False,
    sample_bytes: int | None = None,
    use_blake3: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    progress: Progress | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Runs the cascade over the files on disk; gives the rows that it changes, as they are then, and a one-row summary.

    Each stage reads only what the one before could not tell apart, and its outcome is written to the shared folder before the next starts:
    quick hashes of candidates, then whole digests of those that still agree (progressive: after head and tail samples instead),
    then the count of groups; files with a whole digest become done. use_blake3 reads what has no blake3 yet, also where a sha256 is
    known, as digests of two algorithms can't be compared. Files that are gone become missing, unreadable ones error. Only changed rows are
    written, so a run costs what it finds out, not the catalog's size; later stages see them laid over the files. progress is told of each stage's
    end; tasks report no single files.
    """
    d, scope = config.dedupe, Scope.of(config, include, exclude)
    quick_bytes, chunk, sample = d.quick_hash_bytes, d.sha_chunk_bytes, sample_bytes or config.default_sample()
    if network_friendly:
        quick_bytes, chunk, sample = config.network_friendly(sample_bytes)
    before, changed = files, None
    done = {"quick_hash": 0, "sha256": 0}
    lost = {"missing": 0, "error": 0}

    def stage(name: str, candidates: DataFrame, digests: set[str], size: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        nonlocal files, changed
        found = settled(hash_files(candidates, digests, size, chunk))
        n = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        for k in lost:
            lost[k] += n.get(k, 0)
        done[name] = n.get("success", 0)
        rows = transitions.touched(files, found)
        rows = settled(transitions.apply_failures(apply(rows, found), found))
        changed = rows if changed is None else settled(transitions.overlay(changed, rows))
        files = transitions.overlay(before, changed)
        if progress:
            progress(name, done[name], sum(n.values()), f"{name}: {done[name]:,} of {sum(n.values()):,} files read")

    if quick_hash:
        stage("quick_hash", quick_hash_candidates(files, scope), {"quick_hash"}, quick_bytes, transitions.apply_quick_hash)
    if sha256:
        whole = "blake3" if use_blake3 else "sha256"
        digest = {whole}
        if progressive:
            stage("heads", _without_sha(files, scope, whole), {"h1"}, sample, transitions.apply_samples)
            stage("tails", progressive_candidates(files, scope, whole)[0], {"h2"}, sample, transitions.apply_samples)
            candidates = progressive_candidates(files, scope, whole)[1]
        else:
            candidates = sha_candidates(files, scope, network_friendly, whole)
            small = candidates.where(F.col("quick_hash").isNull() & (F.col("size_bytes") < scope.small))
            digest = digest | ({"quick_hash"} if small.limit(1).count() else set())
        stage("sha256", candidates, digest, quick_bytes, transitions.apply_sha)
    finished = settled(transitions.mark_done(files.where(transitions.becomes_done(files))))
    changed = finished if changed is None else transitions.overlay(changed, finished)
    scoped = files.where(prefix_filter("path_abs", include, exclude))
    summary = groups.duplicate_summary(scoped).select(
        F.lit(done["quick_hash"] + done["sha256"]).cast("long").alias("files_processed"),
        F.lit(lost["missing"]).cast("long").alias("files_missing"),
        F.lit(lost["error"]).cast("long").alias("files_error"),
        F.lit(done["quick_hash"]).cast("long").alias("quick_hash_count"),
        F.lit(done["sha256"]).cast("long").alias("sha256_count"),
        F.col("groups").alias("duplicate_groups"),
        F.col("files").alias("duplicate_files"),
        "wasted_bytes",
    )
    return settled(changed), summary


def detect_duplicates(files: DataFrame, config: CatalogConfig, **options) -> tuple[DataFrame, DataFrame]:
    """The new snapshot of files and the one-row summary of detect_changes, whose options it takes."""
    changed, summary = detect_changes(files, config, **options)
    return transitions.overlay(files, changed), summary


def hash_queue(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), force: bool = False) -> DataFrame:
    """Active files under the path filter without a blake3 digest (with force: all), for the whole-digest pass."""
    rows = groups.active(files).where(prefix_filter("path_abs", include, exclude))
    return (rows if force else rows.where(F.coalesce("blake3", F.lit("")) == "")).select("file_id", "path_abs", "size_bytes")


def hash_changes(files: DataFrame, config: CatalogConfig, *, include: Sequence[str] = (), exclude: Sequence[str] = (), force: bool = False, mirror: bool = False, digest: str = "blake3") -> tuple[DataFrame, DataFrame]:
    """The whole-digest pass over the queue: the rows that it changes, and a one-row summary of candidates, hashed, missing and errors."""
    found = settled(hash_files(hash_queue(files, include, exclude, force), {digest}, chunk=config.dedupe.sha_chunk_bytes))
    if digest != "blake3":
        found = found.withColumn("blake3", F.col(digest))
    rows = transitions.apply_failures(transitions.apply_full_digest(transitions.touched(files, found), found, mirror), found, clear_blake3=True)
    return settled(rows), transitions.run_counters(found)


def hash_all(files: DataFrame, config: CatalogConfig, **options) -> tuple[DataFrame, DataFrame]:
    """The new snapshot of files and the summary of hash_changes, whose options it takes."""
    changed, summary = hash_changes(files, config, **options)
    return transitions.overlay(files, changed), summary
