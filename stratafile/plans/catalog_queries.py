"""Queries over the catalog's own operators, with the SQL that checks them. Thresholds are the production defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, formats, paths
from ..operators import cascade, copylog, explorer, groups, keepers, status, transitions
from ..operators.cascade import Scope
from ..schema import CatalogConfig
from .core_queries import sql_code, sql_micros, table

SCOPE = Scope()
#: Paths that the filtered queries are about: one root in another case, and one drive but for a share of its folders.
INCLUDE, EXCLUDE = ["s:\\JOBS\\", "/srv/vault2/"], ["S:\\jobs\\00000"]
FILTERED = Scope(include=INCLUDE, exclude=EXCLUDE)
#: Samples of the quick digest, and of head and tail, as in production.
QUICK_SAMPLE, SAMPLE = CatalogConfig([]).dedupe.quick_hash_bytes, CatalogConfig([]).default_sample()
MANIFEST = "S:\\Jobs\\"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scans")


def _by_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without blake3: the SQL of these queries is about sha256 alone."""
    return _files(spark, sf_dir).drop("blake3")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ACTIVE = "state NOT IN ('error', 'missing')"


def _under(prefixes: list[str], c: str = "path_abs") -> str:
    return "(" + " OR ".join(f"{_LOW.format(c)} LIKE '{p.rstrip(chr(92) + '/').lower()}%'" for p in prefixes) + ")"


_FILTER = f"{_under(INCLUDE)} AND NOT {_under(EXCLUDE)}"
_KEYS = f"""k AS (SELECT size_bytes, coalesce(ext, '') AS ext FROM files
  WHERE {_ACTIVE} AND size_bytes >= 262144 GROUP BY 1, 2 HAVING count(*) >= 5)"""
_TWICE = "d AS (SELECT quick_hash FROM files WHERE quick_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
_IN_KEYS = "(f.size_bytes, coalesce(f.ext, '')) IN (SELECT (size_bytes, ext) FROM k)"
_STARTS = f"st AS (SELECT scan_run_id, max({sql_micros('started_at')}) AS run_at FROM scans GROUP BY 1)"
_LATEST = f"""{_STARTS}, l AS (SELECT * FROM (
  SELECT f.*, row_number() OVER (PARTITION BY lower(path_abs) ORDER BY run_at DESC NULLS LAST, f.scan_run_id DESC NULLS LAST, file_id DESC NULLS LAST) AS rn
  FROM files f LEFT JOIN st USING (scan_run_id)) x WHERE rn = 1 OR path_abs IS NULL)"""
_MTIME = f"coalesce({sql_micros('mtime_utc')}, 0)"


@query("""SELECT count(*) AS total, count(*) FILTER (state = 'done') AS done,
  count(*) FILTER (state IN ('pending', 'quick_hashed', 'sha_pending')) AS pending, count(*) FILTER (state = 'error') AS errors FROM files""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.status_counts(_files(spark, sf_dir))


@query("SELECT state, count(*) AS n FROM files GROUP BY 1")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.state_histogram(_files(spark, sf_dir))


@query("SELECT DISTINCT state FROM files WHERE state IS NOT NULL")
def distinct_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.distinct_states(_files(spark, sf_dir))


@query("""WITH g AS (SELECT sha256 FROM files WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT count(sha256) AS with_sha, count(*) FILTER (state = 'done') AS done,
  count(*) FILTER (state IN ('quick_hashed', 'sha_verified')) AS in_progress,
  (SELECT count(*) FROM g) AS dup_groups, (SELECT count(DISTINCT sha256) FROM g) AS unique_hashes FROM files""")
def digest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.digest_coverage(_files(spark, sf_dir))


@query(f"""WITH a AS (SELECT * FROM files WHERE {_ACTIVE}),
g AS (SELECT count(*) AS cnt FROM a WHERE size_bytes >= 262144 GROUP BY size_bytes, coalesce(ext, '') HAVING count(*) >= 5),
s AS (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS duplicate_population, count(*) AS duplicate_groups FROM g),
t AS (SELECT count(*) AS total_active FROM a)
SELECT total_active, duplicate_population, duplicate_groups, greatest(0, total_active - duplicate_population) AS skipped_singletons FROM t, s""")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.scope_counts(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count)


@query(f"""SELECT size_bytes, coalesce(ext, '') AS ext, count(*) AS cnt FROM files
WHERE {_ACTIVE} AND size_bytes >= 262144 GROUP BY 1, 2 HAVING count(*) >= 5""")
def size_ext_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.size_ext_groups(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count)


@query(f"""WITH {_KEYS} SELECT f.file_id, f.path_abs, f.size_bytes FROM files f
WHERE f.quick_hash IS NULL AND {_ACTIVE} AND f.size_bytes >= 262144 AND {_IN_KEYS}""")
def quick_hash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quick_hash_candidates(_files(spark, sf_dir), SCOPE)


@query(f"""WITH {_KEYS} SELECT f.file_id, f.path_abs, f.size_bytes FROM files f
WHERE f.quick_hash IS NULL AND {_ACTIVE} AND f.size_bytes >= 262144 AND {_IN_KEYS} AND {_FILTER}""")
def quick_hash_candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quick_hash_candidates(_files(spark, sf_dir), FILTERED)


@query("SELECT quick_hash, count(*) AS cnt FROM files WHERE quick_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_quick_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.repeated(_files(spark, sf_dir), "quick_hash")


def _sha_sql(network: bool, small: int = 131072, least: int = 262144) -> str:
    other = "" if network else f" OR (f.size_bytes < {small} AND f.quick_hash IS NULL AND f.size_bytes >= {least})"
    keys = _KEYS.replace("262144", str(least))
    return f"""WITH {keys}, {_TWICE} SELECT f.file_id, f.path_abs, f.size_bytes, f.quick_hash FROM files f
WHERE f.sha256 IS NULL AND {_ACTIVE} AND {_IN_KEYS} AND (f.quick_hash IN (SELECT quick_hash FROM d){other})"""


#: Thresholds under which the arm of small files isn't empty, as it is with the defaults.
SMALL = Scope(min_size=1024)


@query(_sha_sql(False, least=1024))
def sha_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.sha_candidates(_files(spark, sf_dir), SMALL)


@query(_sha_sql(True))
def sha_candidates_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.sha_candidates(_files(spark, sf_dir), SCOPE, network_friendly=True)


_PROGRESSIVE = f"""WITH {_KEYS.replace("262144", "1024")},
p AS (SELECT f.* FROM files f WHERE f.sha256 IS NULL AND {_ACTIVE} AND {_IN_KEYS}),
c1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes, h1) AS n1 FROM p WHERE h1 IS NOT NULL) x WHERE n1 > 1),
c2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes, h1, h2) AS n2 FROM c1 WHERE h2 IS NOT NULL) y WHERE n2 > 1)"""


@query(_PROGRESSIVE + " SELECT file_id, size_bytes, h1 FROM c1")
def h1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.progressive_candidates(_files(spark, sf_dir), SMALL)[0].select("file_id", "size_bytes", "h1")


@query(_PROGRESSIVE + " SELECT file_id, size_bytes, h1, h2 FROM c2")
def progressive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.progressive_candidates(_files(spark, sf_dir), SMALL)[1].select("file_id", "size_bytes", "h1", "h2")


_SHA_GROUPS = f"""SELECT sha256, count(*) AS cnt, CAST(sum(size_bytes) AS BIGINT) AS total_size FROM files
WHERE sha256 IS NOT NULL AND {_ACTIVE} GROUP BY 1 HAVING count(*) > 1"""


@query(_SHA_GROUPS)
def sha_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.sha_groups(_by_sha(spark, sf_dir))


@query(f"""SELECT count(*) AS groups, CAST(sum(cnt) AS BIGINT) AS files, round(sum(CAST(total_size AS DOUBLE) - CAST(total_size AS DOUBLE) / cnt), 0) AS wasted_bytes
FROM ({_SHA_GROUPS}) g""")
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.duplicate_summary(_by_sha(spark, sf_dir)).withColumn("wasted_bytes", F.round("wasted_bytes", 0))


def _report_sql(strict: bool) -> str:
    return f"""WITH g AS (SELECT sha256, count(*) AS cnt, min(size_bytes) AS size_bytes FROM files
  WHERE sha256 IS NOT NULL AND {_ACTIVE} GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT *, size_bytes * (cnt - 1) AS total_wasted, row_number() OVER (ORDER BY size_bytes * (cnt - 1) DESC, sha256) AS rank FROM g)
SELECT CAST(r.rank AS INTEGER) AS rank, r.sha256, r.cnt, r.size_bytes, r.total_wasted, f.file_id, f.path_abs, f.mtime_utc
FROM r JOIN files f ON f.sha256 = r.sha256 WHERE r.rank <= 100{' AND f.' + _ACTIVE if strict else ''}"""


@query(_report_sql(True))
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 100 groups are the feature."""
    return groups.duplicate_report(_by_sha(spark, sf_dir), 100)


@query(_report_sql(False))
def duplicate_report_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.duplicate_report(_by_sha(spark, sf_dir), 100, compatible=True)


def _plan_sql(order: str) -> str:
    return f"""WITH {_LATEST},
p AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS cnt, row_number() OVER (PARTITION BY sha256 ORDER BY {_MTIME} {order}, lower(path_abs), file_id) AS rk
  FROM l WHERE sha256 IS NOT NULL AND path_abs IS NOT NULL AND {_ACTIVE})
SELECT sha256, file_id, path_abs, size_bytes, rk AS rank, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS role FROM p WHERE cnt > 1"""


@query(_plan_sql("ASC"))
def prune_plan_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers.prune_plan(_by_sha(spark, sf_dir), _scans(spark, sf_dir), "oldest")


@query(_plan_sql("DESC"))
def prune_plan_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers.prune_plan(_by_sha(spark, sf_dir), _scans(spark, sf_dir), "newest")


@query(f"""SELECT count(*) FILTER (role = 'keep') AS hash_groups, count(*) FILTER (rank = 2) AS groups_modified,
  count(*) FILTER (role = 'remove') AS files_considered, CAST(coalesce(sum(size_bytes) FILTER (role = 'remove'), 0) AS BIGINT) AS potential_bytes
FROM ({_plan_sql("ASC")}) x""")
def prune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers.prune_stats(keepers.prune_plan(_by_sha(spark, sf_dir), _scans(spark, sf_dir), "oldest"))


@query(f"""WITH p AS (SELECT * FROM ({_plan_sql("DESC")}) x)
SELECT count(*) FILTER (role = 'keep') AS kept, count(*) FILTER (role = 'remove') AS removed,
  count(*) FILTER (role = 'remove' AND EXISTS (SELECT 1 FROM p o WHERE lower(o.path_abs) = lower(p.path_abs) AND o.file_id <> p.file_id)) AS unsafe FROM p""")
def prune_plan_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals that have the path of a keeper, or a path twice: none, whatever case a path was listed in."""
    return keepers.plan_safety(keepers.prune_plan(_by_sha(spark, sf_dir), _scans(spark, sf_dir), "newest"))


@query(f"SELECT file_id, sha256 FROM files WHERE file_id NOT IN (SELECT file_id FROM ({_plan_sql('ASC')}) x WHERE role = 'remove')")
def files_after_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _by_sha(spark, sf_dir)
    plan = keepers.prune_plan(files, _scans(spark, sf_dir), "oldest")
    return transitions.without(files, plan.where(F.col("role") == "remove")).select("file_id", "sha256")


def _meta_sql(where: str = "true") -> str:
    return f"""SELECT size_bytes, lower(name) AS name_key, coalesce(ext, '') AS ext_key, count(*) AS cnt FROM files
WHERE {_ACTIVE} AND size_bytes >= 262144 AND {where} GROUP BY 1, 2, 3 HAVING count(*) >= 5"""


@query(_meta_sql())
def metadata_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.metadata_groups(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count)


@query(f"""WITH g AS ({_meta_sql(_FILTER)}) SELECT file_id, path_abs, size_bytes, name, ext, mtime_utc FROM files f
WHERE {_ACTIVE} AND {_FILTER} AND (size_bytes, lower(name), coalesce(ext, '')) IN (SELECT (size_bytes, name_key, ext_key) FROM g)""")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups.metadata_rows(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count, INCLUDE, EXCLUDE)
    return rows.select("file_id", "path_abs", "size_bytes", "name", "ext", "mtime_utc")


@query(f"""WITH g AS ({_meta_sql(_FILTER)}) SELECT file_id FROM files f
WHERE {_ACTIVE} AND (size_bytes, lower(name), coalesce(ext, '')) IN (SELECT (size_bytes, name_key, ext_key) FROM g)""")
def metadata_rows_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.metadata_rows(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count, INCLUDE, EXCLUDE, compatible=True).select("file_id")


@query(f"""WITH g AS ({_meta_sql()}), m AS (
  SELECT size_bytes, lower(name) AS name_key, coalesce(ext, '') AS ext_key, file_id,
    row_number() OVER (PARTITION BY size_bytes, lower(name), coalesce(ext, '') ORDER BY path_abs, file_id) AS place
  FROM files WHERE {_ACTIVE} AND size_bytes >= 262144 AND (size_bytes, lower(name), coalesce(ext, '')) IN (SELECT (size_bytes, name_key, ext_key) FROM g))
SELECT * FROM m WHERE place <= 3""")
def metadata_first_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members of each metadata group, as its listing shows."""
    rows = groups.metadata_rows(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count)
    rows = rows.select("size_bytes", F.lower("name").alias("name_key"), groups.ext_or_empty().alias("ext_key"), "file_id", "path_abs")
    return groups.first_members(rows, ["size_bytes", "name_key", "ext_key"], [F.asc("path_abs"), F.asc("file_id")]).drop("path_abs")


@query(f"SELECT CAST(coalesce(sum(size_bytes * (cnt - 1)), 0) AS BIGINT) AS wasted_bytes FROM ({_meta_sql()}) g")
def metadata_wasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.metadata_wasted(groups.metadata_groups(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count))


@query(f"""WITH {_LATEST},
m AS (SELECT *, count(*) OVER (PARTITION BY size_bytes, lower(name), coalesce(ext, '')) AS cnt FROM l WHERE {_ACTIVE} AND size_bytes >= 262144),
r AS (SELECT file_id, row_number() OVER (PARTITION BY size_bytes, lower(name), lower(coalesce(ext, '')) ORDER BY {_MTIME}, lower(path_abs), file_id) AS rk FROM m WHERE cnt >= 2)
SELECT file_id FROM r WHERE rk > 1""")
def metadata_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keepers.metadata_prune(_files(spark, sf_dir), _scans(spark, sf_dir), SCOPE.min_size, 2)


@query(f"SELECT file_id, path_abs, size_bytes FROM files WHERE {_ACTIVE} AND coalesce(blake3, '') = '' AND {_FILTER}")
def hash_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.hash_queue(_files(spark, sf_dir), INCLUDE, EXCLUDE)


@query(f"SELECT file_id, path_abs, size_bytes FROM files WHERE {_ACTIVE} AND coalesce(blake3, '') = ''")
def hash_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.hash_queue(_files(spark, sf_dir))


@query(f"""WITH g AS ({_meta_sql()}) SELECT file_id, path_abs, size_bytes, name, ext, mtime_utc FROM files f
WHERE {_ACTIVE} AND (size_bytes, lower(name), coalesce(ext, '')) IN (SELECT (size_bytes, name_key, ext_key) FROM g)""")
def metadata_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.metadata_rows(_files(spark, sf_dir), SCOPE.min_size, SCOPE.min_count).select("file_id", "path_abs", "size_bytes", "name", "ext", "mtime_utc")


@query("""SELECT count(*) AS candidates, count(*) FILTER (o = 'success') AS hashed, count(*) FILTER (o = 'missing') AS missing, count(*) FILTER (o = 'error') AS errors
FROM (SELECT CASE WHEN state IN ('missing', 'error') THEN state WHEN sha256 IS NOT NULL THEN 'success' END AS o FROM files) x""")
def hash_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that had the outcomes that the catalog shows."""
    outcome = F.when(F.col("state").isin("missing", "error"), F.col("state")).when(F.col("sha256").isNotNull(), "success")
    return transitions.run_counters(_files(spark, sf_dir).select(outcome.alias("outcome")))


@query(f"SELECT file_id FROM files WHERE {_FILTER}")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(paths.prefix_filter("path_abs", INCLUDE, EXCLUDE)).select("file_id")


@query("SELECT file_id FROM files WHERE NOT contains(path_abs, '/Old/') AND NOT contains(path_abs, '\\Temp\\') AND lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) IN ('.pdf', '.dwg')")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner's whitelist and exclusions, over the listed paths."""
    keep = paths.not_containing("path_abs", ["/Old/", "", "\\Temp\\"]) & paths.suffix_of("name").isin(".pdf", ".dwg")
    return _files(spark, sf_dir).where(keep).select("file_id")


@query(r"""SELECT file_id, regexp_extract(path_abs, '^(.*)[\\/][^\\/]*$', 1, 's') AS dir, regexp_extract(path_abs, '([^\\/]*)$', 1) AS name,
  lower(regexp_extract(regexp_extract(path_abs, '([^\\/]*)$', 1), '^.+([.][^.]+)$', 1)) AS ext FROM files""")
def scan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = paths.name_of("path_abs")
    return _files(spark, sf_dir).select("file_id", paths.dir_of("path_abs").alias("dir"), name.alias("name"), paths.suffix_of(name).alias("ext"))


_FOUND = " OR ".join(f"coalesce({_LOW.format(c)} LIKE '%vault2%', false)" for c in ("path_abs", "name", "ext", "state", "error_msg"))


@query(f"""SELECT file_id, path_abs, dir, name, ext, size_bytes, mtime_utc, ctime_utc, state, error_msg FROM files
WHERE state = 'done' AND ({_FOUND}) ORDER BY ext ASC NULLS FIRST, file_id LIMIT 100 OFFSET 100""")
def explorer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page is the feature."""
    return explorer.page(_files(spark, sf_dir), 2, 100, "Vault2", "done", "ext")


@query(f"SELECT count(*) AS n FROM files WHERE state = 'done' AND ({_FOUND})")
def explorer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.count(_files(spark, sf_dir), "Vault2", "done")


_HAY = "lower(concat_ws(' ', nullif(path_abs, ''), nullif(name, ''), nullif(ext, ''), nullif(state, ''), nullif(error_msg, '')))"


@query(f"SELECT file_id FROM files WHERE contains({_HAY}, '.pdf done')")
def explorer_haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(explorer.haystack(".PDF done")).select("file_id")


@query(r"""SELECT path, depth, count(*) AS files FROM (
  SELECT array_to_string(list_slice(parts, 1, k), '/') AS path, k AS depth FROM (
    SELECT parts, unnest(range(1, len(parts) + 1))::INTEGER AS k FROM (
      SELECT list_filter(string_split(replace(dir, '\', '/'), '/'), lambda x: x <> '') AS parts FROM files WHERE dir IS NOT NULL) a) b) c
GROUP BY 1, 2""")
def explorer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.tree(_files(spark, sf_dir))


_FIRST = "(SELECT * FROM files ORDER BY path_abs NULLS FIRST, file_id LIMIT 50000)"


@query(r"""SELECT path, depth, count(*) AS files FROM (
  SELECT array_to_string(list_slice(parts, 1, k), '/') AS path, k AS depth FROM (
    SELECT parts, unnest(range(1, len(parts) + 1))::INTEGER AS k FROM (
      SELECT list_filter(string_split(replace(dir, '\', '/'), '/'), lambda x: x <> '') AS parts FROM FIRST WHERE dir IS NOT NULL) a) b) c
GROUP BY 1, 2""".replace("FIRST", _FIRST))
def explorer_tree_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50,000 files by path are the feature."""
    return explorer.tree(_files(spark, sf_dir), 50_000)


@query(r"""SELECT file_id, array_to_string(way, '/') AS path, array_to_string(list_slice(way, 1, len(way) - 1), '/') AS parent, coalesce(way[-1], '') AS name, CAST(len(way) AS INTEGER) AS depth
FROM (SELECT file_id, list_filter(string_split(replace(path_abs, '\', '/'), '/'), lambda x: x <> '') AS way FROM files WHERE path_abs IS NOT NULL) x""")
def explorer_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.leaves(_files(spark, sf_dir))


_UNHASHED = f"sha256 IS NULL AND {_ACTIVE} AND {_under(['S:'])}"


@query(f"""SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, coalesce(avg(size_bytes), 0) AS avg_bytes,
  coalesce(min(size_bytes), 0) AS min_bytes, coalesce(max(size_bytes), 0) AS max_bytes FROM files WHERE {_UNHASHED}""")
def workload_unhashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.workload_unhashed(_files(spark, sf_dir))


_WORK = f"""WITH k AS (SELECT size_bytes, coalesce(ext, '') AS ext FROM files WHERE {_ACTIVE} AND {_under(['S:'])} AND size_bytes >= 1024 GROUP BY 1, 2 HAVING count(*) >= 2),
w AS (SELECT count(*) AS files, CAST(coalesce(sum(f.size_bytes), 0) AS BIGINT) AS total_bytes, coalesce(avg(f.size_bytes), 0) AS avg_bytes FROM files f WHERE {_UNHASHED} AND {_IN_KEYS})"""


@query(_WORK + " SELECT * FROM w")
def workload_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.workload_candidates(_files(spark, sf_dir))


@query(f"""SELECT CASE WHEN size_bytes < 1048576 THEN '< 1 MB' WHEN size_bytes < 10485760 THEN '1-10 MB' WHEN size_bytes < 104857600 THEN '10-100 MB'
  WHEN size_bytes < 524288000 THEN '100-500 MB' WHEN size_bytes < 1073741824 THEN '500 MB - 1 GB' ELSE '> 1 GB' END AS bucket,
  count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files WHERE {_UNHASHED} AND size_bytes >= 0 GROUP BY 1""")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.size_buckets(_files(spark, sf_dir))


@query(_WORK + """ SELECT total_bytes, total_bytes / 104857600.0::DOUBLE AS network_seconds, total_bytes / 524288000.0::DOUBLE AS local_seconds,
  total_bytes / 104857600.0::DOUBLE / 8 AS network_seconds_parallel, total_bytes / 524288000.0::DOUBLE / 8 AS local_seconds_parallel FROM w""")
def workload_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.workload_estimate(_files(spark, sf_dir))


@query(_WORK + f""", b AS (SELECT count(*) AS large_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS large_bytes FROM files WHERE {_UNHASHED} AND size_bytes > 1048576),
s AS (SELECT total_bytes AS dup_bytes, large_files, large_bytes, large_files * 65536 + total_bytes - large_bytes AS progressive_bytes FROM w, b)
SELECT *, dup_bytes - progressive_bytes AS savings_bytes, progressive_bytes / 104857600.0::DOUBLE / 8 AS progressive_seconds FROM s""")
def progressive_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.progressive_savings(_files(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT coalesce(ext, '') AS ext, name FROM files WHERE name IS NOT NULL),
s AS (SELECT ext, list(name ORDER BY name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY name) AS k FROM n) x WHERE k <= 3 GROUP BY 1)
SELECT ext, count(*) AS n, coalesce(any_value(s.samples), []) AS samples FROM (SELECT coalesce(ext, '') AS ext FROM files) f LEFT JOIN s USING (ext) GROUP BY ext""")
def extension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.extension_summary(_files(spark, sf_dir))


_TOP = "SELECT coalesce(ext, '') AS ext, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, ext LIMIT 20"


@query(f"""WITH n AS (SELECT DISTINCT coalesce(ext, '') AS ext, name FROM files WHERE name IS NOT NULL),
s AS (SELECT ext, list(name ORDER BY name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY name) AS k FROM n) x WHERE k <= 2 GROUP BY 1)
SELECT f.ext, f.n, coalesce(s.samples, []) AS samples FROM ({_TOP}) f LEFT JOIN s USING (ext)""")
def extension_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 extensions with most files, the feature."""
    return status.extension_summary(_files(spark, sf_dir), 2, 20)


_CATEGORY = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{name}'" for name, exts in status.CATEGORIES.items())


@query(f"""SELECT CASE {_CATEGORY} ELSE 'other' END AS category, count(*) AS extensions, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT coalesce({sql_code('ext')}, '') AS ext, count(*) AS n FROM files GROUP BY 1) x GROUP BY 1""")
def extension_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.extension_categories(_files(spark, sf_dir))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogued files whose text is in documents: of several texts of a file the one with the lowest doc_id. file_id, text."""
    docs = table(spark, sf_dir, "documents").where(F.col("file_id").isNotNull() & F.col("text").isNotNull())
    return docs.groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text"))


_DOCS = "c AS (SELECT file_id, arg_min(text, doc_id) AS text FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"
_QUICK = f"md5(length(text)::VARCHAR || left(text, {QUICK_SAMPLE}) || CASE WHEN length(text) > {QUICK_SAMPLE} THEN right(text, {QUICK_SAMPLE}) ELSE '' END)"


@query(f"""SELECT doc_id, sha256(text) AS sha256, {_QUICK} AS quick_digest, md5(left(text, {SAMPLE})) AS h1,
  CASE WHEN length(text) = 0 THEN '' ELSE md5(right(text, {SAMPLE})) END AS h2 FROM documents WHERE text IS NOT NULL""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, sampled, head and tail digests of every text from one scan."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select(
        "doc_id",
        digests.sha256_hex("text").alias("sha256"),
        digests.sampled_digest("text", F.length("text"), QUICK_SAMPLE).alias("quick_digest"),
        digests.head_digest("text", SAMPLE).alias("h1"),
        digests.tail_digest("text", SAMPLE).alias("h2"),
    )


@query(f"""WITH {_DOCS} SELECT f.file_id, coalesce({_QUICK}, f.quick_hash) AS quick_hash, CASE WHEN c.text IS NOT NULL THEN 'quick_hashed' ELSE f.state END AS state
FROM files f LEFT JOIN c ON f.file_id = c.file_id AND f.{_ACTIVE} AND f.quick_hash IS NULL""")
def apply_quick_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    own = groups.active(files).where(F.col("quick_hash").isNull()).select("file_id")
    found = _contents(spark, sf_dir).join(own, "file_id", "left_semi")
    found = found.select("file_id", digests.sampled_digest("text", F.length("text"), QUICK_SAMPLE).alias("quick_hash"), F.lit("success").alias("outcome"))
    return transitions.apply_quick_hash(files, found).select("file_id", "quick_hash", "state")


@query(f"""WITH {_DOCS}, u AS (
  SELECT f.file_id, coalesce(sha256(c.text), f.sha256) AS sha256, coalesce(f.quick_hash, {_QUICK.replace('text', 'c.text')}) AS quick_hash,
    CASE WHEN c.text IS NOT NULL THEN 'sha_verified' ELSE f.state END AS state
  FROM files f LEFT JOIN c ON f.file_id = c.file_id AND f.{_ACTIVE} AND f.sha256 IS NULL)
SELECT file_id, sha256, quick_hash, CASE WHEN state IN ('quick_hashed', 'sha_verified') AND sha256 IS NOT NULL THEN 'done' ELSE state END AS state FROM u""")
def apply_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    own = groups.active(files).where(F.col("sha256").isNull()).select("file_id")
    found = _contents(spark, sf_dir).join(own, "file_id", "left_semi").select(
        "file_id",
        digests.sha256_hex("text").alias("sha256"),
        digests.sampled_digest("text", F.length("text"), QUICK_SAMPLE).alias("quick_hash"),
        F.lit(None).cast("string").alias("blake3"),
        F.lit("success").alias("outcome"),
    )
    return transitions.mark_done(transitions.apply_sha(files.drop("blake3"), found)).select("file_id", "sha256", "quick_hash", "state")


@query(f"""WITH {_DOCS} SELECT f.file_id, coalesce(md5(left(c.text, {SAMPLE})), f.h1) AS h1, coalesce(CASE WHEN length(c.text) = 0 THEN '' ELSE md5(right(c.text, {SAMPLE})) END, f.h2) AS h2
FROM files f LEFT JOIN c ON f.file_id = c.file_id""")
def apply_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _contents(spark, sf_dir).select("file_id", digests.head_digest("text", SAMPLE).alias("h1"), digests.tail_digest("text", SAMPLE).alias("h2"), F.lit("success").alias("outcome"))
    return transitions.apply_samples(_files(spark, sf_dir), found).select("file_id", "h1", "h2")


@query(f"""WITH {_DOCS} SELECT f.file_id, CASE WHEN c.text IS NOT NULL THEN sha256(c.text) ELSE f.sha256 END AS sha256,
  CASE WHEN c.text IS NOT NULL THEN sha256(c.text) ELSE f.blake3 END AS blake3,
  CASE WHEN c.text IS NOT NULL AND coalesce(f.state, '') NOT IN ('error', 'missing') THEN 'sha_verified' ELSE f.state END AS state
FROM files f LEFT JOIN c ON f.file_id = c.file_id""")
def hash_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-digest pass with mirroring; sha-256 stands in for the digest, whose library isn't everywhere."""
    found = _contents(spark, sf_dir).select("file_id", digests.sha256_hex("text").alias("blake3"), F.lit("success").alias("outcome"))
    return transitions.apply_full_digest(_files(spark, sf_dir), found, mirror=True).select("file_id", "sha256", "blake3", "state")


@query("SELECT file_id, CASE WHEN state IN ('quick_hashed', 'sha_verified') AND sha256 IS NOT NULL THEN 'done' ELSE state END AS state FROM files")
def mark_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.mark_done(_by_sha(spark, sf_dir)).select("file_id", "state")


_GONE = "(coalesce(error_code, '') <> '' AND state = 'done')"


@query(f"""SELECT file_id, CASE WHEN {_GONE} THEN 'missing' ELSE state END AS state, CASE WHEN {_GONE} THEN 'not_found' ELSE error_code END AS error_code FROM files""")
def mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are done but carry an error code, taken as gone."""
    files = _files(spark, sf_dir)
    found = files.where((F.coalesce("error_code", F.lit("")) != "") & (F.col("state") == "done"))
    found = found.select("file_id", F.lit("missing").alias("outcome"), F.lit("gone").alias("message"))
    return transitions.apply_failures(files, found).select("file_id", "state", "error_code")


@query("""SELECT file_id, CASE WHEN scan_run_id = (SELECT max(scan_run_id) FROM files) AND state = 'quick_hashed' THEN 'done' ELSE state END AS state FROM files""")
def finish_last_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    last = files.agg(F.max("scan_run_id")).first()[0]
    return transitions.finish_scan(files, last if last is not None else -1).select("file_id", "state")


_MANIFEST = f"{_LOW.format('dir')} LIKE 's:\\jobs\\%' AND {_LOW.format('path_abs')} LIKE 's:\\jobs\\%' AND {_ACTIVE}"


@query(f"SELECT dir, count(*) AS files, min(name) AS first_name, max(name) AS last_name FROM files WHERE {_MANIFEST} GROUP BY 1")
def copy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copylog.manifest_counts(_files(spark, sf_dir), MANIFEST)


@query(f"""SELECT dir, name, coalesce(nullif(substr(dir, 9), ''), '(root)') AS display,
  concat('robocopy "', replace(dir, '"', '\\"'), '" "', replace(CASE WHEN substr(dir, 9) = '' THEN 'D:\\Copy' ELSE concat('D:\\Copy\\', substr(dir, 9)) END, '"', '\\"'), '" "',
    replace(name, '"', '\\"'), '" /MT:16 /R:2 /W:5 /NFL /NDL /NP /BYTES /TEE /LOG+:copy.log') AS line
FROM files WHERE {_MANIFEST}""")
def copy_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copylog.script_lines(_files(spark, sf_dir), MANIFEST, "D:\\Copy")


_NUM = "list_transform(string_split_regex(regexp_extract({}, '^(,*[0-9][0-9,]*(\\s+,*[0-9][0-9,]*)*)(\\s|$)', 1), '\\s+'), lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT))"
_LOG = f"""WITH t AS (SELECT log_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM copylog),
p AS (SELECT *, regexp_replace(regexp_extract(line, '^[^:]*:(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS rest FROM t WHERE line <> ''),
v AS (SELECT *, line LIKE 'Files :%' AS is_files, line LIKE 'Bytes :%' AS is_bytes, line LIKE 'Started :%' AS is_start,
  regexp_matches(rest, '^(,*[0-9][0-9,]*(\\s+,*[0-9][0-9,]*)*)(\\s|$)') AS has, {_NUM.format('rest')} AS a FROM p)"""
_SUMS = ", ".join(
    [f"CAST(coalesce(sum(coalesce(a[{k + 2}], 0)) FILTER (is_files AND has), 0) AS BIGINT) AS {c}" for k, c in enumerate(copylog.COUNTERS)]
    + [f"CAST(coalesce(sum(coalesce(a[{k + 1}], 0)) FILTER (is_bytes AND has), 0) AS BIGINT) AS bytes_{c}" for k, c in enumerate(["total", *copylog.COUNTERS])]
)


@query(f"""{_LOG} SELECT log_id, count(*) FILTER (is_files AND has) AS blocks, {_SUMS},
  arg_max(rest, line_no) FILTER (is_files AND NOT has AND rest <> '') AS last_file FROM v GROUP BY 1""")
def copylog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each log; starts and the last status are covered by tests, as SQL can't read the times alike."""
    return copylog.summary(table(spark, sf_dir, "copylog"), ["log_id"]).drop("start_time", "last_start", "last_status")


@query(f"""{_LOG} SELECT count(*) FILTER (is_files AND has) AS blocks, {_SUMS} FROM v""")
def copylog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copylog.summary(table(spark, sf_dir, "copylog")).drop("start_time", "last_start", "last_status", "last_file")


_TIME = r"""try_strptime(regexp_replace(regexp_extract(rest, '^(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,\s+([A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s+[AaPp][Mm])$', 2), '\s+', ' ', 'g'), '%B %d, %Y %I:%M:%S %p')"""
_HOW = "CASE WHEN a[2] > 0 THEN 'copied' WHEN a[3] > 0 THEN 'skipped' WHEN a[5] > 0 THEN 'failed' WHEN a[4] > 0 THEN 'mismatch' WHEN a[6] > 0 THEN 'extra' END"


@query(f"""{_LOG}, w AS (SELECT log_id, line_no, is_start, CASE WHEN is_start THEN {_TIME} END AS t, CASE WHEN is_files AND has THEN {_HOW} END AS status FROM v)
SELECT log_id, arg_min(t, line_no) FILTER (t IS NOT NULL) AS start_time, arg_max_null(t, line_no) FILTER (is_start) AS last_start, arg_max(status, line_no) FILTER (status IS NOT NULL) AS last_status FROM w GROUP BY 1""")
def copylog_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last start and last status of each log."""
    return copylog.summary(table(spark, sf_dir, "copylog"), ["log_id"]).select("log_id", "start_time", "last_start", "last_status")


def _sized(c: str, decimals: int, last: int = 6) -> str:
    """A size with its unit in whole numbers: halves are rounded up, as by the operator."""
    one, names = 10**decimals, formats.UNITS[:last]
    out = f"CASE WHEN {c} IS NULL THEN '' WHEN {c} < 1024 THEN concat({c}, ' B')"
    for k, name in enumerate(names, 1):
        q = f"((CAST({c} AS HUGEINT) * {2 * one} + {1024**k}) // {2 * 1024**k})"
        cond = "ELSE" if k == len(names) else f"WHEN {c} < {1024 ** (k + 1)} THEN"
        out += f" {cond} concat({q} // {one}, '.', lpad(CAST({q} % {one} AS VARCHAR), {decimals}, '0'), ' {name}')"
    return out + " END"


@query(f"SELECT file_id, {_sized('size_bytes', 1)} AS explorer, {_sized('size_bytes', 2)} AS monitor, {_sized('size_bytes', 2, 3)} AS report FROM files")
def formatted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explorer's, monitor's and report's form of each size."""
    return _files(spark, sf_dir).select(
        "file_id",
        formats.format_bytes("size_bytes").alias("explorer"),
        formats.format_bytes("size_bytes", 2).alias("monitor"),
        formats.format_bytes("size_bytes", 2, "GB").alias("report"),
    )


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, concat(printf('%.1f', l_quantity), ' ', CASE l_linenumber % 4 WHEN 0 THEN 'KB' WHEN 1 THEN 'mb' WHEN 2 THEN 'XB' ELSE '' END) AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor(CAST(regexp_extract(text, '^[0-9.]+') AS DOUBLE) * CASE l_linenumber % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1 END) AS BIGINT) AS bytes FROM s""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*(F.lit(u) for u in ("KB", "mb", "XB", ""))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(F.format_string("%.1f", F.col("l_quantity")), F.lit(" "), unit)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.parse_human_size(text).alias("bytes"))


@query("SELECT DISTINCT f.scan_run_id, s.host FROM files f JOIN scans s USING (scan_run_id)")
def files_with_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link from files to scans; files are reduced to their runs before they meet scans."""
    runs = _files(spark, sf_dir).select("scan_run_id").distinct()
    return runs.join(table(spark, sf_dir, "scans").select("scan_run_id", "host"), "scan_run_id")


_LINES = SQL["copy_script"]


@query(f"""WITH c AS ({_LINES}), t AS (SELECT count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS b FROM files WHERE {_MANIFEST}),
d AS (SELECT dir, any_value(display) AS display, row_number() OVER (ORDER BY dir) AS idx, count(*) OVER () AS dirs FROM c GROUP BY dir),
h AS (SELECT unnest([{{'part': 0, 'kind': 0, 'line': '@echo off'}}, {{'part': 0, 'kind': 1, 'line': 'REM Source: {MANIFEST}'}}, {{'part': 0, 'kind': 2, 'line': 'REM Destination: D:\\Copy'}},
  {{'part': 0, 'kind': 3, 'line': format('REM Total files: {{:,}}', n)}}, {{'part': 0, 'kind': 4, 'line': concat('REM Total size: ', {_sized('b', 2)})}}, {{'part': 0, 'kind': 5, 'line': 'REM Threads: 16'}},
  {{'part': 2, 'kind': 0, 'line': 'echo Copy complete.'}}, {{'part': 2, 'kind': 1, 'line': 'pause'}}], recursive := true) FROM t)
SELECT part, '' AS dir, kind, '' AS name, line FROM h
UNION ALL SELECT 1, dir, 0, '', concat('echo ', idx, '/', dirs, ': ', display) FROM d UNION ALL SELECT 1, dir, 2, '', 'echo.' FROM d
UNION ALL SELECT 1, dir, 1, name, line FROM c""")
def copy_script_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copylog.script(_files(spark, sf_dir), MANIFEST, "D:\\Copy")


_SECONDS = "(l_orderkey * l_linenumber * 7 - 500)"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, greatest(CAST({_SECONDS} AS BIGINT), 0) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, concat(CASE WHEN s >= 86400 THEN concat(s // 86400, 'd ') ELSE '' END, printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60)) AS duration FROM s""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.format_duration(F.col("l_orderkey") * F.col("l_linenumber") * 7 - 500).alias("duration"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) - 5 AS d, CAST(l_linenumber AS DOUBLE) * 12 AS t, CAST(l_orderkey % 7 AS DOUBLE) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 AND t > d AND e > 0 THEN CAST(trunc((t - d) / (d / e)) AS BIGINT) END AS eta FROM x""")
def etas(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, total, elapsed = F.col("l_quantity").cast("double") - 5, F.col("l_linenumber").cast("double") * 12, (F.col("l_orderkey") % 7).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.eta_seconds(done, total, elapsed).alias("eta"))
