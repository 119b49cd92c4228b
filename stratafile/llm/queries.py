"""Queries of the training-data problems, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core_queries import sql_code, sql_micros, table
from . import frequency, history, leaks, representative, tokens, truncation


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files are the history; intake is delivered against it."""
    index = history.HistoryIndex(spark)
    index.append(table(spark, sf_dir, "files"))
    found = index.deliver(table(spark, sf_dir, "intake"))
    index.drop()
    return found


def p2_by_delivery(spark: SparkSession, sf_dir: str, deliveries: int = 6) -> DataFrame:
    """The same, intake being delivered in turn: each delivery holds an equal span of batches, and meets those before it in the index."""
    index, intake = history.HistoryIndex(spark), table(spark, sf_dir, "intake")
    index.append(table(spark, sf_dir, "files"))
    first, last = intake.agg(F.min("batch_id"), F.max("batch_id")).first()
    found = index.deliver(intake.where(F.col("batch_id").isNull()))
    if first is not None:
        span = -(-(last - first + 1) // deliveries)
        for at in range(first, last + 1, span):
            found = found.unionByName(index.deliver(intake.where(F.col("batch_id").between(at, at + span - 1))))
    index.drop()
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.copies_to_keep(table(spark, sf_dir, "files"), table(spark, sf_dir, "scans"))


def _counts(spark: SparkSession, sf_dir: str) -> frequency.TermCounts:
    counts = frequency.TermCounts(spark, ["ext", "state"], ["error_code"])
    counts.apply(added=table(spark, sf_dir, "files"))
    return counts


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).marked().select("field", "val", "mark")


def p4_after_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of files, then changed by what intake adds and by the rows of files in state error going away."""
    counts = _counts(spark, sf_dir)
    gone = table(spark, sf_dir, "files").where(F.col("state") == "error")
    for _ in range(2):  # the second time it changes nothing
        counts.apply(added=table(spark, sf_dir, "intake"), removed=gone, delivery="intake")
    return counts.marked()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that leaked."""
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p8_at_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents, and whether each is flagged at a significant length of its source."""
    return truncation.truncated_with_limits(table(spark, sf_dir, "documents"))


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.truncation_by_source(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_by_delivery": p2_by_delivery,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_after_intake": p4_after_intake,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_clean_texts": p7_clean_texts,
    "p8_found": p8_found,
    "p8_at_limits": p8_at_limits,
    "p8_by_source": p8_by_source,
}


def _valid(c: str, shape: str) -> str:
    x = sql_code(c)
    return f"CASE WHEN regexp_matches({x}, '^({shape})$') AND replace({x}, {x}[1], '') <> '' THEN {x} END"


_SHA, _QUICK = _valid("sha256", "[0-9a-f]{64}"), _valid("quick_hash", "[0-9a-f]{16}|[0-9a-f]{40}")
_ACTIVE = f"coalesce({sql_code('state')} NOT IN ('error', 'missing', ''), false) AND size_bytes > 0"


def _marks(rows: str) -> str:
    return f"""
WITH f AS ({rows}),
t AS (
  SELECT 'ext' AS field, {sql_code('ext')} AS val, rid FROM f
  UNION ALL SELECT 'state', {sql_code('state')}, rid FROM f
  UNION ALL SELECT 'error_code', unnest(regexp_extract_all(lower(error_code), '[a-z0-9_]+')), rid FROM f),
c AS (SELECT field, val, count(*) AS occ, count(DISTINCT rid) AS recs FROM t WHERE val <> '' GROUP BY 1, 2)
SELECT *, CASE WHEN occ < 6 THEN 'rare' WHEN recs * 100 > (SELECT count(*) FROM f) * 10 THEN 'common' ELSE 'mid' END AS mark FROM c"""


SQL: dict[str, str] = {
    "p2_found": f"""
WITH a AS (
  SELECT file_id, true AS new, {_SHA} AS s, {_QUICK} AS q, size_bytes, coalesce({sql_code('ext')}, '') AS e FROM intake WHERE {_ACTIVE}
  UNION ALL SELECT file_id, false, {_SHA}, {_QUICK}, size_bytes, coalesce({sql_code('ext')}, '') FROM files WHERE {_ACTIVE}),
m AS (
  SELECT file_id, new, CASE WHEN s IS NOT NULL THEN min(file_id) OVER (PARTITION BY s) END AS x,
         CASE WHEN q IS NOT NULL THEN min(file_id) OVER (PARTITION BY q, size_bytes, e) END AS y FROM a)
SELECT CASE WHEN x < file_id THEN x ELSE y END AS match_id, file_id, CASE WHEN x < file_id THEN 'exact' ELSE 'near' END AS kind
FROM m WHERE new AND (x < file_id OR y < file_id)""",
    "p3_found": f"""
WITH f AS (
  SELECT f.*, lower(path_abs) AS p,
         row_number() OVER (PARTITION BY lower(path_abs) ORDER BY {sql_micros('started_at')} DESC NULLS LAST, f.scan_run_id DESC, file_id DESC) AS rn
  FROM files f LEFT JOIN scans USING (scan_run_id) WHERE path_abs IS NOT NULL),
g AS (
  SELECT file_id, p, {_SHA} AS sha256, {sql_micros('mtime_utc')} AS m, {sql_micros('last_seen_at')} AS seen
  FROM f WHERE rn = 1 AND {_ACTIVE}),
r AS (
  SELECT *, count(*) OVER (PARTITION BY sha256) AS n,
         row_number() OVER (PARTITION BY sha256 ORDER BY CASE WHEN m <= seen THEN m END DESC NULLS LAST, p) AS k
  FROM g WHERE sha256 IS NOT NULL)
SELECT sha256, file_id FROM r WHERE n > 1 AND k = 1""",
    "p4_found": f"SELECT field, val, mark FROM ({_marks('SELECT ext, state, error_code, file_id AS rid FROM files')}) x",
    "p4_after_intake": _marks(
        "SELECT ext, state, error_code, file_id AS rid FROM files WHERE state IS DISTINCT FROM 'error' UNION ALL SELECT ext, state, error_code, file_id FROM intake"
    ),
}
SQL["p2_by_delivery"] = SQL["p2_found"]
