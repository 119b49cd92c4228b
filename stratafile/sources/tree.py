"""Scanning directory trees."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import dir_of, name_of, not_containing, suffix_of
from ..schema import FILES
from ..session import arrow_map

LISTED = "path_abs string, is_dir boolean, size_bytes long, mtime double, ctime double, error string"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each directory, not of those below; a directory that can't be read gives a row with its error. Links to directories aren't followed."""
    schema = pa.schema([("path_abs", pa.string()), ("is_dir", pa.bool_()), ("size_bytes", pa.int64()), ("mtime", pa.float64()), ("ctime", pa.float64()), ("error", pa.string())])
    for batch in batches:
        for directory in batch.column("path_abs").to_pylist():
            rows = []
            try:
                entries = list(os.scandir(directory))
            except FileNotFoundError:
                continue
            except OSError as e:
                entries = []
                rows.append({"path_abs": directory, "is_dir": False, "size_bytes": 0, "mtime": None, "ctime": None, "error": str(e)})
            for entry in entries:
                row = {"path_abs": entry.path, "is_dir": False, "size_bytes": 0, "mtime": None, "ctime": None, "error": None}
                try:
                    if entry.is_dir():
                        if entry.is_symlink():
                            continue
                        row["is_dir"] = True
                    else:
                        st = entry.stat()
                        row |= {"size_bytes": st.st_size, "mtime": st.st_mtime, "ctime": st.st_ctime}
                except OSError as e:
                    row["error"] = str(e)
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _iso(c: str):
    at = F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def scan_tree(spark: SparkSession, root: str, scan_run_id: int, include_ext: list[str] | None = None, exclude_paths: list[str] | None = None, first_id: int = 1) -> DataFrame:
    """Lists a tree and gives its files as catalog rows of one run.

    Level by level: the directories of a level are dealt to the executors, which list them; the driver only sees whether there is another
    level. Files pass if their suffix is among include_ext (all, if it is empty), and if their path and the directories they lie in hold none of exclude_paths. A
    file or directory that can't be read becomes a row in state error with the code process and size 0. A missing root gives no rows.
    """
    from ..session import settled

    excluded = exclude_paths or []
    level = spark.createDataFrame([(root,)], "path_abs string").where(not_containing("path_abs", excluded))
    found: DataFrame | None = None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        listed = settled(arrow_map(level.repartition(partitions, "path_abs"), _list, LISTED).where(not_containing("path_abs", excluded)))
        files = listed.where(~F.col("is_dir"))
        found = files if found is None else found.unionByName(files)
        level = listed.where("is_dir").select("path_abs")
        if not level.limit(1).count():
            break
    now = F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    bad = F.col("error").isNotNull()
    name = name_of("path_abs")
    rows = found.select(
        (F.monotonically_increasing_id() + first_id).alias("file_id"),
        F.lit(scan_run_id).cast("long").alias("scan_run_id"),
        "path_abs",
        dir_of("path_abs").alias("dir"),
        name.alias("name"),
        suffix_of(name).alias("ext"),
        "size_bytes",
        F.when(bad, now).otherwise(_iso("mtime")).alias("mtime_utc"),
        F.when(bad, now).otherwise(_iso("ctime")).alias("ctime_utc"),
        F.when(bad, "error").otherwise("quick_hashed").alias("state"),
        F.when(bad, "process").alias("error_code"),
        F.col("error").alias("error_msg"),
        now.alias("last_seen_at"),
    )
    if include_ext:
        rows = rows.where(F.col("ext").isin([e.lower() for e in include_ext]))
    missing = [f for f in FILES if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(*FILES.names)


def scan_row(spark: SparkSession, root: str, scan_run_id: int) -> DataFrame:
    """The row of a run in scans."""
    import getpass
    import socket

    from ..schema import SCANS

    started = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return spark.createDataFrame([(scan_run_id, started, root, socket.gethostname(), getpass.getuser())], SCANS)
