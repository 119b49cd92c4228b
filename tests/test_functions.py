import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafile.functions import digests, formats, paths, text
from stratafile.functions.instants import instant_micros


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def results(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(make("x")).collect()]


def python_micros(x):
    try:
        t = dt.datetime.fromisoformat(x)
    except (TypeError, ValueError):
        return None
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def test_instants(spark):
    good = ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "2024-02-29T23:59:59.123456+05:30", "1969-12-31T23:59:59.9-08:00", "0001-01-01T00:00:00Z", "2107-06-06T00:00:00.000Z"]
    bad = [None, "", "garbage", "2023-02-29T00:00:00Z", "0000-00-00T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "2024-13-01T00:00:00Z", "2024-01-01", "2024-01-01T00:00:00+24:00", " 2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z\n", "2024-01-01T00:00:00.1234567Z"]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert results(spark, good, instant_micros) == [python_micros(x) for x in good]
            assert results(spark, bad, instant_micros) == [None] * len(bad)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text_keys(spark):
    assert results(spark, ["\u00a0\t.PDF \n", None, "", " "], text.ext_key) == [".pdf", "", "", ""]
    assert results(spark, ["S:\\Jobs\\", "/srv/x//", "/", None], text.root_key) == ["s:\\jobs", "/srv/x", "", None]
    assert results(spark, ["done", " ERROR", "missing ", " ", None, "x"], text.is_active) == [True, False, False, False, False, True]
    good = "0123456789abcdef" * 4
    assert results(spark, [good, f" {good.upper()}\n", "0" * 64, good[:-1], good + "0", None, "f" * 63 + "g"], text.valid_sha256) == [good, good, None, None, None, None, None]
    assert results(spark, ["0" * 15 + "1", "a" * 16, "b" * 39 + "c", "b" * 20], text.valid_quick_hash) == ["0" * 15 + "1", None, "b" * 39 + "c", None]
    codes = ["process", "x; PROCESS|y", "process_x", "a process", None, ""]
    assert results(spark, codes, lambda c: text.has_code(c, "process")) == [True, True, False, True, False, False]


def test_suffixes_and_names(spark):
    assert results(spark, ["a.PDF", "a.tar.gz", ".bashrc", "a.", "README", None], paths.suffix_of) == [".pdf", ".gz", "", "", "", None]
    assert results(spark, ["S:\\a\\b.txt", "/x/y", "z"], paths.name_of) == ["b.txt", "y", "z"]
    assert results(spark, ["S:\\a\\b.txt", "/x/y", "z"], paths.dir_of) == ["S:\\a", "/x", ""]
    got = results(spark, ["S:\\a\\b"], paths.ancestors)[0]
    assert [(r.path, r.depth) for r in got] == [("S:", 1), ("S:/a", 2), ("S:/a/b", 3)]


def test_path_filter(spark):
    under = lambda *p: lambda c: paths.prefix_filter(c, p)
    assert results(spark, ["s:\\JOBS\\x", "S:\\jobs2\\x", "S:\\other", "S:\\É"], under("S:\\jobs\\")) == [True, True, False, False]
    assert results(spark, ["/axb/f", "/ab/f"], under("/a_b")) == [True, False]
    assert results(spark, ["É", "é"], under("é")) == [False, True]
    assert results(spark, ["/a/x", "/a/y/z", None], lambda c: paths.prefix_filter(c, ["/a"], ["/A/Y"])) == [True, False, None]
    assert results(spark, ["/a/Old/x", "/a/old/x"], lambda c: paths.not_containing(c, ["Old", ""])) == [False, True]


def test_formats(spark):
    sizes = [1023, 1024, 1536, 2**20, 2**50 * 1500, None, 0]
    assert results(spark, sizes, formats.format_bytes, "long") == ["1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.5 EB", "", "0 B"]
    assert results(spark, [1536, 2**41], lambda c: formats.format_bytes(c, 2, "GB"), "long") == ["1.50 KB", "2048.00 GB"]
    assert results(spark, [0, 59, 3661, 90061, -5], formats.format_duration, "long") == ["00:00:00", "00:00:59", "01:01:01", "1d 01:01:01", "00:00:00"]
    assert results(spark, ["1.5 GB", "12", "1,024 KB", "x", "", "3 XB", None], formats.parse_human_size) == [1610612736, 12, 1048576, None, None, 3, None]
    assert results(spark, ["5 3 1", "5 3 x 1", "x", "1 2 3 4 5 6 7", "1,000 2", "3x", "", None], formats.summary_values) == [[5, 3, 1, 0, 0, 0], [5, 3, 0, 0, 0, 0], None, [1, 2, 3, 4, 5, 6], [1000, 2, 0, 0, 0, 0], None, None, None]
    assert results(spark, [" Monday, January 01, 2024 10:00:00 AM", "January 1", "", None], formats.copy_time) == [dt.datetime(2024, 1, 1, 10), None, None, None]
    etas = spark.createDataFrame([(50, 100, 10), (0, 100, 10), (100, 100, 10), (1, 2, 0)], "d long, t long, e long")
    assert [r[0] for r in etas.select(formats.eta_seconds("d", "t", "e")).collect()] == [10, None, None, None]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 17])
def test_quick_hash_reads_tail_only_beyond_sample(tmp_path, spark, size):
    import xxhash

    content = bytes(range(size))
    path = tmp_path / "f"
    path.write_bytes(content)
    tail = content[-8:] if size > 8 else b""
    want = xxhash.xxh64(str(size).encode() + content[:8] + tail).hexdigest()
    row = digests.hash_files(spark.createDataFrame([(1, str(path), size)], "file_id long, path_abs string, size_bytes long"), {"quick_hash", "sha256", "h1", "h2"}, sample=8, chunk=3).first()
    import hashlib

    assert (row.quick_hash, row.sha256, row.outcome) == (want, hashlib.sha256(content).hexdigest(), "success")
    assert row.h2 == ("" if not size else xxhash.xxh64(content[-8:]).hexdigest())


def test_missing_and_unreadable_files(tmp_path, spark):
    rows = [(1, str(tmp_path / "none"), 1), (2, str(tmp_path), 1), (3, None, 1)]
    out = {r.file_id: r.outcome for r in digests.hash_files(spark.createDataFrame(rows, "file_id long, path_abs string, size_bytes long"), {"sha256"}).collect()}
    assert out == {1: "missing", 2: "error", 3: "error"}


def test_blake3_is_refused_where_its_library_is_missing(spark):
    if digests.blake3_available():
        pytest.skip("blake3 is installed")
    with pytest.raises(ModuleNotFoundError):
        digests.hash_files(spark.createDataFrame([], "file_id long, path_abs string, size_bytes long"), {"blake3"})


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_trimmed_is_strip(spark, values):
    values = [v.replace("\x00", "") for v in values]
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert results(spark, values, text.trimmed) == [v.strip() for v in values]


def test_content_digests_of_null_and_empty(spark):
    df = column(spark, [None, "", "abc"]).select(F.col("x"), digests.head_digest("x", 2), digests.tail_digest("x", 2), digests.sampled_digest("x", F.length("x"), 2))
    assert [tuple(r)[2] for r in df.collect()][:2] == [None, ""]
