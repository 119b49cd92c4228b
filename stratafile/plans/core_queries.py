"""Queries of the general data problems, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ext_key
from ..operators.common import take
from ..operators.skew import balanced_aggregate, heavy_keys
from ..operators.snapshots import run_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_changes(table(spark, sf_dir, "files"), table(spark, sf_dir, "scans"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = take(table(spark, sf_dir, "files"), "size_bytes", "ext", "file_id", "scan_run_id")
    return rows.withColumn("ext", ext_key("ext"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_pairs(spark, sf_dir), ["size_bytes", "ext"], ["file_id"]).select("size_bytes", "ext")


def p5_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every pair of size and extension: rows, and the span of ids and runs."""
    out = balanced_aggregate(_pairs(spark, sf_dir), ["size_bytes", "ext"], ["file_id"], ["file_id", "scan_run_id"])
    return out.select("size_bytes", "ext", "n", "file_id_min", "file_id_max", "scan_run_id_min", "scan_run_id_max")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p5_found": p5_found, "p5_pair_totals": p5_pair_totals}

WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"


def sql_code(c: str) -> str:
    return f"lower(trim({c}, {WS}))"


def sql_micros(c: str) -> str:
    """Microseconds of an instant in DuckDB, NULL if unreadable."""
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?$"
    zone = f"regexp_extract({c}, '([+-][0-9]{{2}}:[0-9]{{2}})$', 1)"
    local = f"regexp_replace({c}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')"
    offset = f"CASE WHEN {zone} = '' THEN 0 ELSE (CASE WHEN {zone}[1] = '-' THEN -1 ELSE 1 END) * (try_cast({zone}[2:3] AS BIGINT) * 60 + try_cast({zone}[5:6] AS BIGINT)) END"
    return f"CASE WHEN regexp_matches({c}, '{iso}') AND {c} NOT LIKE '0000%' THEN epoch_us(try_cast({local} AS TIMESTAMP)) - ({offset}) * 60000000 END"


_RUNS = f"""runs AS (
  SELECT scan_run_id, lag(scan_run_id) OVER (PARTITION BY rtrim(lower(root_path), '\\/') ORDER BY {sql_micros('started_at')} NULLS FIRST, scan_run_id) AS prev
  FROM scans WHERE scan_run_id IN (SELECT scan_run_id FROM files))"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH {_RUNS},
f AS (SELECT * FROM (
  SELECT scan_run_id, lower(path_abs) AS path_key, size_bytes, {sql_micros('mtime_utc')} AS m,
         list_contains(regexp_extract_all(lower(coalesce(error_code, '')), '[a-z0-9_]+'), 'process') AS unknown,
         row_number() OVER (PARTITION BY scan_run_id, lower(path_abs) ORDER BY file_id DESC) AS rn
  FROM files WHERE path_abs IS NOT NULL) x WHERE rn = 1),
n AS (SELECT r.scan_run_id AS run, f.* EXCLUDE (scan_run_id) FROM f JOIN runs r ON f.scan_run_id = r.scan_run_id WHERE r.prev IS NOT NULL),
o AS (SELECT r.scan_run_id AS run, f.* EXCLUDE (scan_run_id) FROM f JOIN runs r ON f.scan_run_id = r.prev)
SELECT coalesce(n.run, o.run) AS scan_run_id, coalesce(n.path_key, o.path_key) AS path_key,
       CASE WHEN o.run IS NULL THEN 'added' WHEN n.run IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL OUTER JOIN o ON n.run = o.run AND n.path_key = o.path_key
WHERE o.run IS NULL OR n.run IS NULL
   OR (NOT n.unknown AND NOT o.unknown AND (n.size_bytes IS DISTINCT FROM o.size_bytes OR coalesce(n.m <> o.m, false)))""",
    "p5_found": f"""
SELECT size_bytes, coalesce({sql_code('ext')}, '') AS ext FROM files
GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM files)""",
    "p5_pair_totals": f"""
SELECT size_bytes, coalesce({sql_code('ext')}, '') AS ext, count(*) AS n, min(file_id) AS file_id_min, max(file_id) AS file_id_max,
       min(scan_run_id) AS scan_run_id_min, max(scan_run_id) AS scan_run_id_max
FROM files GROUP BY 1, 2""",
}
