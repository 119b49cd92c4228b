import random

from stratafile.operators.snapshots import diff, row_hash, run_changes


def scan(i, at, root="/r"):
    return {"scan_run_id": i, "started_at": f"2024-01-{at:02}T00:00:00Z", "root_path": root}


def row(i, run, path, size=1, mtime="2024-01-01T00:00:00Z", code=None):
    return {"file_id": i, "scan_run_id": run, "path_abs": path, "size_bytes": size, "mtime_utc": mtime, "error_code": code, "state": "done"}


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_added_removed_changed(make_files, make_scans):
    files = make_files(
        row(1, 1, "/r/A"), row(2, 1, "/r/b"), row(3, 1, "/r/c"), row(4, 1, "/r/d"), row(5, 1, "/r/e", 5), row(6, 1, "/r/f", mtime="x"),
        row(11, 2, "/R/a"), row(12, 2, "/r/b", 2), row(13, 2, "/r/c", mtime="2024-01-01T01:00:00+01:00"), row(15, 2, "/r/e", 0, code="Process; x"), row(16, 2, "/r/f"), row(17, 2, "/r/g"),
    )
    assert found(run_changes(files, make_scans(scan(1, 1), scan(2, 2, "/R/")))) == [(2, "/r/b", "changed"), (2, "/r/d", "removed"), (2, "/r/g", "added")]


def test_order_is_by_start_and_empty_runs_are_left_out(make_files, make_scans):
    files = make_files(row(1, 9, "/r/a"), row(2, 3, "/r/b"))
    scans = make_scans(scan(9, 1), scan(5, 2), scan(3, 3), scan(4, 9, "/other"))
    assert found(run_changes(files, scans)) == [(3, "/r/a", "removed"), (3, "/r/b", "added")]


def test_highest_id_counts_of_repeated_paths(make_files, make_scans):
    files = make_files(row(1, 1, "/r/a", 1), row(5, 2, "/r/A", 1), row(4, 2, "/r/a", 2), row(None, 2, "/r/a", 3), row(5, 2, "/r/A", 1))
    assert found(run_changes(files, make_scans(scan(1, 1), scan(2, 2)))) == []


def test_nulls_unknown_runs_and_empty_tables(make_files, make_scans):
    scans = make_scans(scan(1, 1), scan(2, 2), {"scan_run_id": None, "root_path": None}, {"scan_run_id": 7, "root_path": "/r", "started_at": None})
    files = make_files(row(1, 1, None), row(2, 1, ""), row(3, 2, "", None), row(4, None, "/r/x"), row(5, 99, "/r/y"), row(6, 2, "x" * 100_000))
    assert found(run_changes(files, scans)) == [(2, "", "changed"), (2, "x" * 100_000, "added")]
    assert found(run_changes(make_files(), make_scans())) == []
    assert found(run_changes(make_files(), scans)) == []


def test_clashing_extra_columns(spark, make_files, make_scans):
    files = make_files(row(1, 1, "/r/a"), row(2, 2, "/r/a", 2)).selectExpr("*", "1 AS SIZE_BYTES", "'x' AS row_hash", "true AS _after", "0 AS later_run_id")
    scans = make_scans(scan(1, 1), scan(2, 2)).selectExpr("*", "'z' AS ROOT_PATH", "1 AS at")
    assert found(run_changes(files, scans)) == [(2, "/r/a", "changed")]


def test_row_hash_tells_nulls_apart(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (None, 1), (None, None), (0, 0)], "a long, b long").select(row_hash(F.col("a"), F.col("b")).alias("h"))
    assert df.distinct().count() == 4


def test_diff_against_brute_force(spark):
    rng = random.Random(1)
    for n in (0, 50):
        old = {i: rng.choice([None, 1, 2]) for i in range(n) if rng.random() < 0.7}
        new = {i: rng.choice([None, 1, 2]) for i in range(n) if rng.random() < 0.7}
        side = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "k long, v long").selectExpr("*", "xxhash64(v IS NULL, v) AS row_hash")
        want = [(k, "added" if k not in old else "removed" if k not in new else "changed") for k in old.keys() | new.keys() if k not in old or k not in new or old[k] != new[k]]
        assert found(diff(side(old), side(new), ["k"])) == sorted(want)
