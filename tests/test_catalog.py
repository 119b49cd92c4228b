import os
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratafile import cli
from stratafile.functions import digests
from stratafile.operators import cascade, explorer, groups, keepers, status, transitions
from stratafile.operators.cascade import Scope
from stratafile.schema import FILES, CatalogConfig, DedupeConfig, load_config, migrated
from stratafile.sources.catalog import Catalog, export_parquet
from stratafile.sources.sqlite import import_sqlite, read_sqlite
from stratafile.sources.tree import scan_tree


def row(i, path="/r/a.pdf", **x):
    return {"file_id": i, "scan_run_id": 1, "path_abs": path, "dir": os.path.dirname(path), "name": os.path.basename(path), "ext": ".pdf", "size_bytes": 10, "state": "done", "mtime_utc": "2024-01-01T00:00:00Z", **x}


def ids(df):
    return sorted(r.file_id for r in df.collect())


def test_null_and_empty_extensions_group_together(make_files):
    files = make_files(row(1, ext=None), row(2, ext=""), row(3, ext=".pdf"), row(4, state="error", ext=""), row(5, state=None, ext=""))
    assert [(r.size_bytes, r.ext, r.cnt) for r in groups.size_ext_groups(files, 10, 2).collect()] == [(10, "", 2)]
    assert groups.size_ext_groups(files, 10, 3).count() == 0
    assert groups.size_ext_groups(files, 11, 1).count() == 0
    assert groups.scope_counts(files, 10, 2).first().asDict() == {"total_active": 3, "duplicate_population": 2, "duplicate_groups": 1, "skipped_singletons": 1}
    assert groups.scope_counts(make_files(), 10, 2).first().asDict() == {"total_active": 0, "duplicate_population": 0, "duplicate_groups": 0, "skipped_singletons": 0}


def test_candidates(make_files):
    s = Scope(min_size=10, min_count=2, small=100)
    files = make_files(row(1, quick_hash="q"), row(2), row(3, "/x/b.pdf", quick_hash="q", state="missing"), row(4, ext=".doc"), row(5, size_bytes=500, quick_hash="r"), row(6, size_bytes=500))
    assert ids(cascade.quick_hash_candidates(files, s)) == [2, 6]
    assert ids(cascade.quick_hash_candidates(files, Scope(10, 2, 100, include=["/R/"]))) == [2, 6]
    assert ids(cascade.quick_hash_candidates(files, Scope(10, 2, 100, exclude=["/r"]))) == []
    assert ids(cascade.sha_candidates(files, s)) == [1, 2]
    assert ids(cascade.sha_candidates(files, s, network_friendly=True)) == [1]


def test_collisions_need_all_keys(make_files):
    files = make_files(row(1, h1="a", h2="x"), row(2, h1="a", h2="y"), row(3, h1="a", h2="x"), row(4, h1=None), row(5, h1=None), row(6, h1="b"))
    heads, both = cascade.progressive_candidates(files, Scope(10, 2))
    assert ids(heads) == [1, 2, 3] and ids(both) == [1, 3]


@pytest.fixture
def no_scans(make_scans):
    return make_scans()


def test_a_path_scanned_twice_is_no_duplicate(make_files, no_scans):
    files = make_files(row(1, sha256="s"), row(2, sha256="s", scan_run_id=2), row(3, "/r/b.pdf", sha256="s"), {**row(4, sha256="s"), "path_abs": None})
    assert sorted((r.file_id, r["rank"], r.role) for r in keepers.prune_plan(files, no_scans).collect()) == [(2, 1, "keep"), (3, 2, "remove")]
    assert keepers.prune_plan(files.where("file_id < 3"), no_scans).count() == 0


def test_keepers(make_files, no_scans):
    files = make_files(row(1, "/B", sha256="s"), row(2, "/a", sha256="s"), row(3, "/c", sha256="s", mtime_utc="garbage"), row(4, "/d", sha256="s", mtime_utc="2025-01-01T00:00:00+00:00"), row(5, "/e", sha256="t"))
    order = lambda k: [r.file_id for r in keepers.prune_plan(files, no_scans, k).orderBy("rank").collect()]
    assert order("oldest") == [3, 2, 1, 4]
    assert order("newest") == [4, 2, 1, 3]
    with pytest.raises(ValueError):
        keepers.prune_plan(files, no_scans, "largest")
    stats = keepers.prune_stats(keepers.prune_plan(files, no_scans)).first()
    assert stats.asDict() == {"hash_groups": 1, "groups_modified": 1, "files_considered": 3, "potential_bytes": 30}
    left = transitions.without(files, keepers.prune_plan(files, no_scans).where("role = 'remove'"))
    assert keepers.prune_plan(left, no_scans).count() == 0


def test_no_plan_removes_a_keepers_own_path(make_files, make_scans, spark, tmp_path):
    """Re-cased listings of one path, and a run that was registered late: its id is higher, but it started earlier."""
    scans = make_scans({"scan_run_id": 1, "started_at": "2024-03-01T00:00:00Z"}, {"scan_run_id": 9, "started_at": "2024-02-01T00:00:00Z"})
    files = make_files(
        row(1, "/R/a.PDF", sha256="s", mtime_utc="2024-01-02T00:00:00Z"), row(2, "/r/A.pdf", sha256="s", scan_run_id=9), row(3, "/r/b.pdf", sha256="s", scan_run_id=9), row(4, "/r/B.PDF", sha256="t"),
        row(5, "/x/c.pdf", sha256="s", mtime_utc="2024-01-03T00:00:00Z"),
    )
    plan = keepers.prune_plan(files, scans)
    assert sorted((r.file_id, r.role) for r in plan.collect()) == [(1, "keep"), (5, "remove")]
    assert keepers.plan_safety(plan).first().asDict() == {"kept": 1, "removed": 1, "unsafe": 0}
    assert ids(groups.latest_per_path(files, scans)) == [1, 4, 5]
    assert ids(groups.latest_per_path(files, make_scans())) == [2, 3, 5]
    bad = spark.createDataFrame([(1, "/R/a", "keep"), (2, "/r/A", "remove"), (3, "/r/z", "remove"), (4, "/r/Z", "remove")], "file_id long, path_abs string, role string")
    assert keepers.plan_safety(bad).first().unsafe == 3
    assert ids(keepers.execute_plan(bad)) == [3, 4]


def test_metadata_modes(make_files, no_scans):
    files = make_files(row(1, "/r/A.pdf"), row(2, "/r/x/a.PDF"), row(3, "/s/a.pdf"), row(4, "/r/b.pdf"))
    rows = lambda **x: ids(groups.metadata_rows(files, 10, 2, ["/r"], **x))
    assert rows() == [1, 2] and rows(compatible=True) == [1, 2, 3]
    assert ids(keepers.metadata_prune(files, no_scans, 10, 2)) == [2, 3]
    assert groups.metadata_wasted(groups.metadata_groups(files, 10, 2)).first()[0] == 20


def test_report_modes(make_files):
    files = make_files(row(1, sha256="s"), row(2, "/r/b", sha256="s"), row(3, "/r/c", sha256="s", state="error"), row(4, "/q/d", sha256="t", size_bytes=99), row(5, "/q/e", sha256="t", size_bytes=99))
    report = groups.duplicate_report(files, 1)
    assert [(r["rank"], r.sha256, r.file_id) for r in report.orderBy("file_id").collect()] == [(1, "t", 4), (1, "t", 5)]
    assert ids(groups.duplicate_report(files, 5)) == [1, 2, 4, 5]
    assert ids(groups.duplicate_report(files, 5, compatible=True)) == [1, 2, 3, 4, 5]
    assert ids(groups.duplicate_report(files, 5, include=["/r"])) == [1, 2]
    assert groups.duplicate_report(make_files(), 5).count() == 0


def test_status_of_an_empty_catalog(make_files):
    empty = make_files()
    assert status.status_counts(empty).first().asDict() == {"total": 0, "done": 0, "pending": 0, "errors": 0}
    assert status.workload_unhashed(empty).first().files == 0
    assert status.workload_estimate(empty).first().network_seconds == 0
    assert status.digest_coverage(empty).first().dup_groups == 0
    assert status.size_buckets(empty).count() == 0


def test_explorer(make_files):
    files = make_files(row(1, "/r/b", error_msg="Bad 50%"), row(2, "/r/a", ext=None), row(3, "/q/c", state="error"))
    page = lambda **x: [r.file_id for r in explorer.page(files, **x).collect()]
    assert page() == [3, 2, 1] and page(ascending=False) == [1, 2, 3] and page(number=2, size=2) == [1]
    assert page(sort="ext") == [2, 1, 3] and page(text="BAD 50") == [1] and page(text="r/_") == [1, 2][::-1] and page(state="error") == [3]
    with pytest.raises(ValueError):
        page(sort="1; DROP")
    assert ids(files.where(explorer.haystack("/r/b b"))) == [1]
    assert explorer.pages(0, 100, 1) == (1, 0, 0) and explorer.pages(250, 100, 3) == (3, 201, 250)
    assert {(r.path, r.depth, r.files) for r in explorer.tree(files).collect()} == {("r", 1, 2), ("q", 1, 1)}
    assert {r.path for r in explorer.tree(files, limit=1).collect()} == {"q"}


def test_pages_after_a_row_and_leaves(make_files):
    files = make_files(row(1, "/r/b"), row(2, "/r/a", ext=None), row(3, "\\\\q\\c", ext=None), row(4, "/r/a"), {**row(5), "path_abs": None})
    for sort in ("path_abs", "ext", "size_bytes"):
        want, got, last = [r.file_id for r in explorer.page(files, size=9, sort=sort).collect()], [], None
        while rows := explorer.page_after(files, last, 2, sort=sort).collect():
            got += [r.file_id for r in rows]
            last = (rows[-1][sort], rows[-1].file_id)
        assert got == want and len(got) == 5
    with pytest.raises(ValueError):
        explorer.page_after(files, None, sort="1")
    found = {r.file_id: (r.path, r.parent, r.name, r.depth) for r in explorer.leaves(files).collect()}
    assert found == {1: ("r/b", "r", "b", 2), 2: ("r/a", "r", "a", 2), 3: ("q/c", "q", "c", 2), 4: ("r/a", "r", "a", 2)}
    assert ids(explorer.leaves(files, limit=2)) == [2, 4] and explorer.leaves(make_files()).count() == 0


def test_extensions(make_files):
    files = make_files(row(1, "/c.pdf"), row(2, "/a.pdf"), row(3, "/b.pdf", ext=" .PDF"), row(4, "/x", ext=None), row(5, "/y.zip", ext=".zip"), {**row(6), "name": None})
    top = [(r.ext, r.n, r.samples) for r in status.extension_summary(files, 2, 1).collect()]
    assert top == [(".pdf", 3, ["a.pdf", "c.pdf"])] and status.extension_summary(make_files()).count() == 0
    by = {r.category: (r.extensions, r.n) for r in status.extension_categories(files).collect()}
    assert by == {"documents": (1, 4), "other": (1, 1), "archives": (1, 1)}
    assert {r.category for r in status.extension_categories(files, {"z": [".ZIP"]}).collect()} == {"z", "other"}


def test_unreadable_directories_give_rows(monkeypatch):
    import pyarrow as pa

    from stratafile.sources import tree as source

    def scandir(path):
        raise PermissionError("no entry") if path == "/locked" else FileNotFoundError(path)

    monkeypatch.setattr(source.os, "scandir", scandir)
    rows = [r for b in source._list(iter([pa.RecordBatch.from_pydict({"path_abs": ["/locked", "/none"]})])) for r in b.to_pylist()]
    assert [(r["path_abs"], r["is_dir"], r["error"]) for r in rows] == [("/locked", False, "no entry")]


def test_progress_is_told(spark, tree):
    config, seen = CatalogConfig([str(tree)], dedupe=DedupeConfig(min_file_size=1, min_duplicate_count=2)), []
    changed, summary = cascade.detect_changes(scan_tree(spark, str(tree), 1), config, progress=lambda *x: seen.append(x))
    assert [s[:3] for s in seen] == [("quick_hash", 5, 5), ("sha256", 4, 4)] and summary.first().duplicate_groups == 1
    assert {r.name for r in changed.collect()} == {"a.PDF", "b.pdf", "_c.pdf", "d.pdf", "e.pdf"}


def test_transitions(spark, make_files):
    files = make_files(row(1, state="done"), row(2, state="quick_hashed", sha256="s"), row(3, state="error"), row(4))
    found = spark.createDataFrame([(1, "n", "q", "b", "success", None), (3, "n", "q", "b", "success", None), (4, None, None, None, "missing", "gone")], "file_id long, sha256 string, quick_hash string, blake3 string, outcome string, message string")
    state = lambda df: {r.file_id: r.state for r in df.collect()}
    assert state(transitions.apply_quick_hash(files, found))[1] == "quick_hashed"
    sha = transitions.mark_done(transitions.apply_sha(files, found))
    assert state(sha) == {1: "done", 2: "done", 3: "done", 4: "done"}
    assert state(transitions.apply_full_digest(files, found))[3] == "error"
    failed = {r.file_id: (r.state, r.error_code, r.error_msg) for r in transitions.apply_failures(files, found).collect()}
    assert failed[4] == ("missing", "not_found", "gone") and failed[1] == ("done", None, None)
    assert transitions.run_counters(found).first().asDict() == {"candidates": 3, "hashed": 2, "missing": 1, "errors": 0}


def test_older_layouts(spark):
    old = spark.createDataFrame([(1, "x", "y")], "file_id int, path_abs string, extra string")
    new = migrated(old)
    assert new.columns == [*FILES.names, "extra"] and new.first().file_id == 1 and new.first().h1 is None


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE scans(scan_run_id INTEGER PRIMARY KEY, started_at TEXT, root_path TEXT, host TEXT, user TEXT)")
        con.execute("CREATE TABLE files(file_id INTEGER PRIMARY KEY, path_abs TEXT, size_bytes INTEGER, is_pdf_born_digital INTEGER, state TEXT)")
        con.executemany("INSERT INTO files VALUES (?, ?, ?, ?, ?)", [(i * 3, f"/é/{i}", i, i % 2 if i % 3 else None, None) for i in range(1, 500)])
    rows = read_sqlite(spark, path, "files", FILES, rows_per_task=100, page=7)
    assert rows.columns == FILES.names and rows.rdd.getNumPartitions() > 3
    got = {r.file_id: (r.path_abs, r.size_bytes, r.is_pdf_born_digital, r.h1) for r in rows.collect()}
    assert got == {i * 3: (f"/é/{i}", i, bool(i % 2) if i % 3 else None, None) for i in range(1, 500)}
    catalog = Catalog(spark, str(tmp_path / "cat"))
    import_sqlite(catalog, path)
    assert catalog.files().count() == 499 and catalog.scans().count() == 0
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, str(tmp_path / "none.db"), "files", FILES)


def test_quick_hash_of_binary_contents(spark):
    rows = [(bytes(range(n)), 8) for n in (0, 5, 8, 9, 20)] + [(None, 8)]
    df = spark.createDataFrame(rows, "c binary, n int")
    got = [r[0] for r in df.select(digests.quick_hash_of("c", "n")).collect()]
    assert got == [None if c is None else digests.quick_digest(len(c), c[:8], c[-8:] if len(c) > 8 else b"") for c, _ in rows]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "Old").mkdir(parents=True)
    (root / "sub" / ".hidden").mkdir(parents=True)
    (root / "a.PDF").write_bytes(b"same content" * 40)
    (root / "sub" / "b.pdf").write_bytes(b"same content" * 40)
    (root / "sub" / ".hidden" / "_c.pdf").write_bytes(b"same content" * 40)
    (root / "sub" / "d.pdf").write_bytes(b"other things" * 40)
    (root / "Old" / "e.pdf").write_bytes(b"same content" * 40)
    (root / "f.txt").write_bytes(b"")
    (root / "broken").symlink_to(root / "nowhere")
    return root


def test_scan(spark, tree):
    rows = {os.path.relpath(r.path_abs, tree): r for r in scan_tree(spark, str(tree), 7, exclude_paths=["/Old", ""]).collect()}
    assert set(rows) == {"a.PDF", "sub/b.pdf", "sub/.hidden/_c.pdf", "sub/d.pdf", "f.txt", "broken"}
    a = rows["a.PDF"]
    assert (a.ext, a.name, a.dir, a.size_bytes, a.state, a.scan_run_id) == (".pdf", "a.PDF", str(tree), 480, "quick_hashed", 7)
    assert a.mtime_utc.endswith("+00:00") and abs(os.stat(tree / "a.PDF").st_mtime * 1e6 - spark.createDataFrame([(a.mtime_utc,)], "x string").select(keepers.mtime_micros("x")).first()[0]) < 2
    assert (rows["broken"].state, rows["broken"].error_code, rows["broken"].size_bytes) == ("error", "process", 0)
    assert {r.name for r in scan_tree(spark, str(tree), 7, [".PDF"]).collect()} == {"a.PDF", "b.pdf", "_c.pdf", "d.pdf", "e.pdf"}
    assert scan_tree(spark, str(tree / "none"), 7).count() == 0


@pytest.mark.parametrize("progressive", [False, True])
def test_cascade_on_disk(spark, tree, progressive):
    config = CatalogConfig([str(tree)], dedupe=DedupeConfig(min_file_size=1, min_duplicate_count=2, quick_hash_bytes=64))
    files = scan_tree(spark, str(tree), 1).where(F.col("state") != "error")
    gone = files.where(F.col("name") == "e.pdf").first().path_abs
    os.unlink(gone)
    new, summary = cascade.detect_duplicates(files, config, progressive=progressive, sample_bytes=16, quick_hash=not progressive)
    s = summary.first()
    assert (s.duplicate_groups, s.duplicate_files, s.files_missing > 0) == (1, 3, True)
    by = {r.name: r for r in new.collect()}
    assert by["a.PDF"].sha256 == by["b.pdf"].sha256 and by["a.PDF"].state == "done" and by["e.pdf"].state == "missing"
    assert len(by) == files.count()


def test_what_a_change_writes_does_not_grow_with_the_catalog(spark, make_files, make_scans, tmp_path, monkeypatch):
    catalog, at = Catalog(spark, str(tmp_path / "cat")), tmp_path / "cat"
    assert not catalog.exists() and catalog.next_ids() == (1, 1) and catalog.files().count() == 0
    size = lambda: {p: p.stat().st_size for p in at.rglob("*.parquet")}
    written = lambda old: sum(n for p, n in size().items() if p not in old)
    big = spark.range(1, 20_001).select(F.col("id").alias("file_id"), F.concat(F.lit("/r/"), F.sha2(F.col("id").cast("string"), 256)).alias("path_abs"), F.lit("quick_hashed").alias("state"))
    catalog.append(files=migrated(big), scans=make_scans({"scan_run_id": 1}))
    assert catalog.next_ids() == (2, 20_001)
    before, total = size(), sum(size().values())
    catalog.append(files=make_files(row(20_001)), scans=make_scans({"scan_run_id": 2}))
    catalog.change(make_files(row(5, "/new", state="done"), row(20_001, "/x", state="done")))
    catalog.remove(spark.createDataFrame([(7,), (8,), (8,)], "file_id long"))
    catalog.change(make_files(row(5, "/newer", state="missing")))
    assert written(before) < 0.1 * total and not set(before) - set(size())
    own = {r.file_id: (r.path_abs, r.state) for r in catalog.files().where("file_id IN (5, 7, 8, 20001)").collect()}
    assert own == {5: ("/newer", "missing"), 20_001: ("/x", "done")} and catalog.files().count() == 19_999
    assert catalog.next_ids() == (3, 20_002)
    monkeypatch.setattr("stratafile.sources.catalog.MOST_CHANGES", 3)
    catalog.change(make_files(row(6, "/six")))  # now they are merged
    assert catalog._state()["files"]["changes"] == [] and catalog.files().count() == 19_999
    again = {r.file_id: r.path_abs for r in Catalog(spark, catalog.path).files().where("file_id < 9").collect()}
    assert again[5] == "/newer" and again[6] == "/six" and 7 not in again


def test_commands(spark, tree, tmp_path, capsys, monkeypatch):
    config = tmp_path / "c.json"
    config.write_text(f'{{"roots": ["{tree}"], "db": {{"path": "{tmp_path}/cat"}}, "dedupe": {{"min_file_size": 1, "min_duplicate_count": 2}}}}')
    assert load_config(str(config)).dedupe.min_duplicate_count == 2
    with pytest.raises(SystemExit):
        cli.main(["dedupe", "--config", str(config)])
    assert cli.main(["scan", "--config", str(config)]) == 0
    catalog = Catalog(spark, f"{tmp_path}/cat")
    assert catalog.scans().count() == 1 and catalog.files().where("state = 'done'").count() == 6
    assert cli.main(["dedupe", "--config", str(config), "--delete-duplicates", "--dry-run", "--report"]) == 0
    assert "480 bytes" in capsys.readouterr().out
    assert len(list(Path(tree).rglob("*.pdf"))) == 4
    monkeypatch.setattr("builtins.input", lambda _: "n")
    cli.main(["dedupe", "--config", str(config), "--delete-duplicates"])
    assert len(list(Path(tree).rglob("*.pdf"))) == 4
    cli.main(["dedupe", "--config", str(config), "--delete-duplicates", "--no-confirm"])
    assert len([p for p in Path(tree).rglob("*") if p.is_file() and p.read_bytes().startswith(b"same")]) == 1
    assert catalog.files().where("sha256 IS NOT NULL").groupBy("sha256").count().where("count > 1").count() == 0
    cli.main(["dedupe", "--config", str(config), "--metadata-prune"])
    export_parquet(catalog, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/files.parquet")).count() == catalog.files().count()
    with pytest.raises(FileNotFoundError):
        export_parquet(Catalog(spark, str(tmp_path / "none")), str(tmp_path / "out2"))
    assert cli.main(["gui", "--config", str(config), "--search", "pdf"]) == 0
    assert cli.main([]) == 1


def test_blake3_duplicates_are_summed_reported_and_planned(make_files, no_scans, tmp_path, monkeypatch):
    from stratafile.functions.digests import hash_files

    def stand_in(candidates, wanted, *sizes, **x):
        """sha256 under another name, as the library isn't everywhere."""
        found = hash_files(candidates, {"sha256" if d == "blake3" else d for d in wanted}, *sizes, **x)
        return found.withColumns({"blake3": F.col("sha256"), "sha256": F.lit(None).cast("string")}) if "blake3" in wanted else found

    monkeypatch.setattr(cascade, "hash_files", stand_in)
    for i in (1, 2, 3):
        (tmp_path / f"{i}").write_bytes(b"x" * 10 if i < 3 else b"y" * 10)
    config = CatalogConfig(roots=[], dedupe=DedupeConfig(min_file_size=1, min_duplicate_count=2))
    files = make_files(*(row(i, str(tmp_path / f"{i}"), state="pending") for i in (1, 2, 3)))
    files, summary = cascade.detect_duplicates(files, config, use_blake3=True)
    assert (summary.first().duplicate_groups, summary.first().duplicate_files, summary.first().wasted_bytes) == (1, 2, 10)
    assert {r.file_id: r.state for r in files.collect()} == {1: "done", 2: "done", 3: "quick_hashed"}
    assert ids(groups.duplicate_report(files)) == [1, 2]
    assert sorted((r.file_id, r.role) for r in keepers.prune_plan(files, no_scans).collect()) == [(1, "keep"), (2, "remove")]
    assert cascade.detect_duplicates(files, config, use_blake3=True)[1].first().sha256_count == 0


def test_a_file_with_both_digests_links_them(make_files, no_scans):
    files = make_files(row(1, "/a", sha256="s"), row(2, "/b", sha256="s", blake3="b"), row(3, "/c", blake3="b"), row(4, "/d", blake3="s"), row(5, "/e", blake3=""), row(6, "/f", blake3=""))
    assert ids(groups.duplicate_report(files)) == [1, 2, 3]
    assert ids(keepers.prune_plan(files, no_scans)) == [1, 2, 3]
