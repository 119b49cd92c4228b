"""Changes of the catalog: rows are joined to what was found by file_id, and nothing is updated in place.

`found` has unique file_ids; rows it doesn't name stay as they are. Over all files the functions give the new snapshot, over the touched ones the rows to lay
over the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with(files: DataFrame, found: DataFrame, values: dict[str, Column], columns: list[str]) -> DataFrame:
    """files with columns replaced; the found values are seen as new_x, and `hit` tells whether there are any."""
    new = found.select(F.col("file_id"), *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("hit"))
    return files.join(new, "file_id", "left").withColumns(values).select(*files.columns)


def overlay(files: DataFrame, changed: DataFrame, ids: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """files with rows replaced by the changed ones of the same id. ids: those whose rows go, if more than the changed ones'. Each changed id once."""
    ids = changed if ids is None else ids
    return files.join(ids.select(key), key, "left_anti").select(*files.columns).unionByName(changed.select(*files.columns))


def touched(files: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that something was found about: what the functions below change is among them."""
    return files.join(found.select("file_id"), "file_id", "left_semi").select(*files.columns)



def apply_quick_hash(files: DataFrame, found: DataFrame) -> DataFrame:
    """Sets quick_hash of successes and state quick_hashed, also where the state was done."""
    ok = found.where(F.col("outcome") == "success")
    hit = F.col("hit").isNotNull()
    return _with(files, ok, {"quick_hash": F.when(hit, F.col("new_quick_hash")).otherwise(F.col("quick_hash")), "state": F.when(hit, "quick_hashed").otherwise(F.col("state"))}, ["quick_hash"])


def apply_sha(files: DataFrame, found: DataFrame) -> DataFrame:
    """Sets state sha_verified of successes. A new sha256 or blake3 replaces the old one; a new quick_hash only fills a gap."""
    ok = found.where(F.col("outcome") == "success")
    values = {
        "sha256": F.coalesce("new_sha256", "sha256"),
        "quick_hash": F.coalesce("quick_hash", "new_quick_hash"),
        "blake3": F.coalesce("new_blake3", "blake3"),
        "state": F.when(F.col("hit").isNotNull(), "sha_verified").otherwise(F.col("state")),
    }
    values = {k: v for k, v in values.items() if k in files.columns}
    return _with(files, ok, values, [k for k in values if k != "state"])


def apply_samples(files: DataFrame, found: DataFrame) -> DataFrame:
    """Sets h1 and h2 where new ones were found."""
    return _with(files, found.where(F.col("outcome") == "success"), {c: F.coalesce(f"new_{c}", c) for c in ("h1", "h2")}, ["h1", "h2"])


def apply_failures(files: DataFrame, found: DataFrame, clear_blake3: bool = False) -> DataFrame:
    """Marks what is gone as missing (code not_found) and what can't be read as error (code hash_failed), with the message."""
    bad = found.where(F.col("outcome").isin("missing", "error"))
    hit = F.col("hit").isNotNull()
    code = F.when(F.col("new_outcome") == "missing", "not_found").otherwise("hash_failed")
    values = {
        "state": F.when(hit, F.col("new_outcome")).otherwise(F.col("state")),
        "error_code": F.when(hit, code).otherwise(F.col("error_code")),
        "error_msg": F.when(hit, F.col("new_message")).otherwise(F.col("error_msg")),
    }
    if clear_blake3:
        values["blake3"] = F.when(~hit | hit.isNull(), F.col("blake3"))
    return _with(files, bad, values, ["outcome", "message"])


def apply_full_digest(files: DataFrame, found: DataFrame, mirror: bool = False) -> DataFrame:
    """Sets blake3 and state sha_verified, unless the state is error or missing; mirror also overwrites sha256."""
    hit = F.col("hit").isNotNull()
    values = {
        "blake3": F.when(hit, F.col("new_blake3")).otherwise(F.col("blake3")),
        "state": F.when(hit & ~F.coalesce(F.col("state"), F.lit("")).isin("error", "missing"), "sha_verified").otherwise(F.col("state")),
    }
    if mirror:
        values["sha256"] = F.when(hit, F.col("new_blake3")).otherwise(F.col("sha256"))
    return _with(files, found.where(F.col("outcome") == "success"), values, ["blake3"])


def becomes_done(files: DataFrame) -> Column:
    known = F.col("sha256").isNotNull()
    if "blake3" in files.columns:
        known = known | (F.coalesce("blake3", F.lit("")) != "")
    return F.col("state").isin("quick_hashed", "sha_verified") & known


def mark_done(files: DataFrame) -> DataFrame:
    """State done where it is quick_hashed or sha_verified and a sha256 or blake3 (where there is that column) is known."""
    return files.withColumn("state", F.when(becomes_done(files), "done").otherwise(F.col("state")))


def finish_scan(files: DataFrame, scan_run_id: int) -> DataFrame:
    """State done for the rows of one run that are quick_hashed."""
    mine = (F.col("scan_run_id") == scan_run_id) & (F.col("state") == "quick_hashed")
    return files.withColumn("state", F.when(mine, "done").otherwise(F.col("state")))


def without(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose file_id isn't among the ids."""
    return files.join(ids.select("file_id"), "file_id", "left_anti")


def run_counters(found: DataFrame) -> DataFrame:
    """One row: candidates, hashed, missing, errors."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    return found.agg(F.count(F.lit(1)).alias("candidates"), n("success").alias("hashed"), n("missing").alias("missing"), n("error").alias("errors"))
