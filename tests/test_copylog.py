import datetime as dt

from stratafile.operators import copylog
from stratafile.sources.logs import read_log
from stratafile.streaming import copymonitor
from stratafile.streaming.copymonitor import monitor

LINES = [
    "Started : Monday, January 01, 2024 10:00:00 AM", None, "  ", "Files : report final.pdf", "Files :        5         3         1         0         1         0",
    "Bytes :     1000       600       200         0       200         0", "broken", "Started : garbage", "Files : 2 0 x 9", "Bytes : x",
    "Started : Tuesday, January 02, 2024 1:00:00 PM", "Files :", "  Files : 1,000 0 0 0 7\t", "Files : last one.dwg",
]


def test_summary(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "log_id long, line_no long, line string")
    got = copylog.summary(df).first().asDict()
    assert {k: got[k] for k in ("blocks", "copied", "skipped", "mismatch", "failed", "extras")} == {"blocks": 3, "copied": 3, "skipped": 1, "mismatch": 0, "failed": 8, "extras": 0}
    assert (got["bytes_total"], got["bytes_copied"], got["bytes_failed"]) == (1000, 600, 200)
    assert got["start_time"] == dt.datetime(2024, 1, 1, 10) and got["last_start"] == dt.datetime(2024, 1, 2, 13)
    assert (got["last_file"], got["last_status"]) == ("last one.dwg", "failed")
    assert copylog.summary(df.limit(0)).first().blocks == 0
    assert copylog.summary(df.limit(0), ["log_id"]).count() == 0


def test_header(spark):
    lines = ["REM Total files: 12,345", "rem total size: 1.5 GB", "REM Total size: x", "REM Total files: none", None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert copylog.header(df).first().asDict() == {"total_files": 12345, "total_bytes": 1610612736}


def test_script(spark, make_files, tmp_path):
    rows = [{"file_id": i, "path_abs": f"{d}\\{n}", "dir": d, "name": n, "state": s} for i, (d, n, s) in enumerate([("S:\\J", "a", "done"), ("S:\\J\\x", 'b"', "done"), ("s:\\j\\y", "c", "error"), ("S:\\K", "d", "done")])]
    lines = {r.name: (r.display, r.line) for r in copylog.script_lines(make_files(*rows), "S:\\J", "D:\\T", "l", 4).collect()}
    assert set(lines) == {"a", 'b"'}
    assert lines["a"] == ("(root)", 'robocopy "S:\\J" "D:\\T" "a" /MT:4 /R:2 /W:5 /NFL /NDL /NP /BYTES /TEE /LOG+:l')
    assert '"b\\""' in lines['b"'][1]
    sized = make_files(*({**r, "size_bytes": 1024**3} for r in rows))
    copylog.write_script(sized, "S:\\J", "D:\\T", str(tmp_path / "s"))
    written = [x for p in sorted((tmp_path / "s").glob("part-*")) for x in p.read_text().splitlines()]
    assert written[0] == "@echo off" and written[3:5] == ["REM Total files: 2", "REM Total size: 2.00 GB"]
    assert written[6] == "echo 1/2: (root)" and written[7].startswith('robocopy "S:\\J"') and written[8] == "echo." and written[9] == "echo 2/2: \\x"
    assert written[-2:] == ["echo Copy complete.", "pause"] and len(written) == 14
    again = spark.createDataFrame(list(enumerate(written)), "line_no long, line string")
    assert copylog.header(again).first().asDict() == {"total_files": 2, "total_bytes": 2 * 1024**3}
    assert copylog.script(make_files(), "S:\\J", "D:\\T").count() == 8


def test_monitor(spark, tmp_path):
    """Lines that are appended to a file that was read before count, as do new files; a line that isn't whole yet waits."""
    log, cp = tmp_path / "log", str(tmp_path / "cp")
    log.mkdir()
    text = "\n".join(x or "" for x in LINES) + "\n"
    (log / "a.txt").write_text(text)

    def totals(name, keys=None, cp=cp):
        monitor(spark, str(log), name, cp, None, keys).awaitTermination(120)
        return spark.table(name)

    row = totals("first").first()
    assert (row.blocks, row.copied, row.bytes_total, row.last_file, row.last_status) == (3, 3, 1000, "last one.dwg", "failed")
    assert row.start_time == dt.datetime(2024, 1, 1, 10) and row.last_start == dt.datetime(2024, 1, 2, 13)
    by = {r.log.rsplit("/", 1)[1]: r for r in totals("by_log", ["log"], str(tmp_path / "cp_by")).collect()}
    assert by["a.txt"].copied == 3


def test_appended_lines_are_read_once(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("Files : 5 2 3 0 0 0\nFiles : one.pdf\nFiles : 9 9")
    query = monitor(spark, str(path), "growing", str(tmp_path / "cp"), 0)
    try:
        query.processAllAvailable()
        assert spark.table("growing").first().copied == 2
        with path.open("a") as f:
            f.write(" 0 0 0 0\nFiles : two.pdf\n")
        query.processAllAvailable()
        row = spark.table("growing").first()
        assert (row.blocks, row.copied, row.last_file, row.last_status) == (2, 11, "two.pdf", "copied")
    finally:
        query.stop()


def test_log_ranges_share_no_line(tmp_path):
    path = tmp_path / "a.log"
    lines = [f"line {i} " + "x" * (i % 97) for i in range(500)] + ["y" * 200_000]
    path.write_text("\n".join(lines) + "\nnot whole")
    reader = copymonitor._LogReader(str(path))
    end = reader.latestOffset()
    assert end == {str(path): sum(len(x) + 1 for x in lines)}
    old, copymonitor.TASK_BYTES = copymonitor.TASK_BYTES, 701
    try:
        parts = reader.partitions({}, end)
        assert len(parts) > 50 and [x[2] for p in parts for x in reader.read(p)] == lines
        later = reader.partitions({str(path): len(lines[0]) + 1}, end)
        assert [x[2] for p in later for x in reader.read(p)] == lines[1:]
    finally:
        copymonitor.TASK_BYTES = old


def test_log_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\n".join((x or "").encode() for x in LINES) + b"\n\xff broken\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = copylog.summary(read_log(spark, str(tmp_path)), position="position").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (got.blocks, got.last_file, got.last_status) == (3, "last one.dwg", "failed")
    assert got.start_time == dt.datetime(2024, 1, 1, 10)
