import random

from pyspark.sql import functions as F

from stratafile.llm.representative import copies_to_keep, top_of_group

SHA = [f"{i:02x}" * 31 + "9a" for i in range(1, 30)]


def row(i, run, path, sha, mtime="2024-01-01T00:00:00Z", seen="2024-06-01T00:00:00Z", state="done", size=1):
    return {"file_id": i, "scan_run_id": run, "path_abs": path, "sha256": sha, "mtime_utc": mtime, "last_seen_at": seen, "state": state, "size_bytes": size}


def scan(i, at):
    return {"scan_run_id": i, "started_at": f"2024-01-{at:02}T00:00:00Z", "root_path": "/r"}


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_trusted_time_then_path(make_files, make_scans):
    scans = make_scans(scan(1, 1), scan(2, 2))
    files = make_files(
        row(1, 1, "/a", SHA[0]), row(2, 1, "/b", SHA[0].upper(), "2024-05-01T00:00:00Z"), row(3, 1, "/c", SHA[0], "2030-01-01T00:00:00Z"),
        row(4, 1, "/d", SHA[1], "x"), row(5, 1, "/C", SHA[1], ""), row(6, 1, "/e", SHA[2]), row(7, 1, "/f", SHA[3]), row(8, 1, "/g", SHA[3], state="error"),
        row(9, 1, "/h", SHA[4], size=0), row(10, 1, "/i", SHA[4]), row(11, 1, "/j", "0" * 64), row(12, 1, "/k", "0" * 64),
        row(13, 1, "/l", SHA[5], "2024-05-01T00:00:00Z", None), row(14, 1, "/m", SHA[5], "2023-05-01T00:00:00Z"),
    )
    # /c and /C are one path: its row with the higher id has SHA[1], so the group of SHA[0] is /a and /b
    assert found(copies_to_keep(files, scans)) == sorted([(SHA[0], 2), (SHA[1], 5), (SHA[5], 14)])


def test_only_the_latest_listing_of_a_path_counts(make_files, make_scans):
    scans = make_scans(scan(1, 5), scan(2, 2))
    files = make_files(row(1, 1, "/a", SHA[0]), row(2, 2, "/A", SHA[1]), row(3, 1, "/b", SHA[0]), row(4, 2, "/c", SHA[1]), row(5, 9, "/b", SHA[2]), row(6, None, "/c", SHA[0]), row(7, 1, None, SHA[1]))
    assert found(copies_to_keep(files, scans)) == [(SHA[0], 1)]


def test_against_brute_force(make_files, make_scans):
    rng = random.Random(5)
    scans = make_scans(*(scan(i, rng.randrange(1, 28)) for i in range(1, 8)))
    at = {r.scan_run_id: r.started_at for r in scans.collect()}
    rows = [row(i, rng.randrange(1, 8), rng.choice("/ab/A/xY") + str(rng.randrange(40)), SHA[0] if rng.random() < 0.4 else rng.choice(SHA), f"2024-0{rng.randrange(1, 9)}-01T00:00:00Z", state=rng.choice(["done", "missing"])) for i in range(400)]
    latest = {}
    for r in sorted(rows, key=lambda r: (at[r["scan_run_id"]], r["scan_run_id"], r["file_id"])):
        latest[r["path_abs"].lower()] = r
    groups = {}
    for path, r in latest.items():
        if r["state"] == "done":
            trusted = r["mtime_utc"] if r["mtime_utc"] <= r["last_seen_at"] else ""
            groups.setdefault(r["sha256"], []).append((trusted, path, r["file_id"]))
    want = []
    for sha, own in groups.items():
        if len(own) > 1:
            best = max(t for t, _, _ in own)
            want.append((sha, min((p, i) for t, p, i in own if t == best)[1]))
    assert found(copies_to_keep(make_files(*rows), scans)) == sorted(want)


def test_empty_tables_long_paths_and_clashing_columns(make_files, make_scans):
    assert found(copies_to_keep(make_files(), make_scans())) == []
    files = make_files(row(1, 1, "/" + "x" * 50_000, SHA[0]), row(2, 1, "", SHA[0]), row(2, 1, "", SHA[0])).selectExpr("*", "1 AS PATH_ABS", "2 AS run_at", "3 AS _rank", "4 AS trusted")
    assert found(copies_to_keep(files, make_scans(scan(1, 1)))) == [(SHA[0], 2)]


def test_a_group_of_any_size_sends_few_rows(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 2)
    out = top_of_group(df, ["k"], [F.desc("id")], least=2)
    assert sorted(r.id for r in out.collect()) == [19_998, 19_999]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
