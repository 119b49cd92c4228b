import pytest
from pyspark.sql import functions as F

from stratafile import session
from stratafile.operators.common import hot_keys, is_small, lookup_join, small_join, spread_join, take


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 700).cast("long").alias("k"), "id")
    table = spark.range(0, 800, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(spark.createDataFrame([(1, -1)], "k long, v long"))
    return rows, table


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("parts", ["1", "4"])
def test_lookups_equal_a_plain_join(spark, sides, how, parts):
    rows, table = sides
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        want = sorted(map(str, rows.join(table, "k", how).select("k", "id", "v").collect()))
        assert sorted(map(str, lookup_join(rows, table, ["k"], how).collect())) == want
        for most in (0, 10_000):
            assert sorted(map(str, small_join(rows, table, ["k"], how, most).select("k", "id", "v").collect())) == want
        assert [r.k for r in hot_keys(rows, ["k"], 4).where("k IS NOT NULL").collect()] == ([1] if parts else [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_take_prefers_exact_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, a int, b int")
    assert take(df, "a", "b").first().asDict() == {"a": 2, "b": 3}
    assert take(df.select("b"), "B").columns == ["B"]
    with pytest.raises(ValueError):
        take(df, "c")


def test_bytes_count_as_well_as_rows(spark):
    t = spark.createDataFrame([(1, "x" * 1000, [1, 2]), (2, None, None)], "k long, s string, a array<int>")
    assert is_small(t) and not is_small(t, most=1) and not is_small(t, most_bytes=1000)
    assert is_small(t.limit(0), 0, 0)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_joins_of_keys_that_repeat_on_both_sides(spark, sides, most):
    rows, table = sides
    table = table.union(table.select("k", F.col("v") + 1)).where("k < 40")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        want = sorted(map(tuple, rows.join(table, "k").select("k", "id", "v").collect()))
        assert sorted(map(tuple, spread_join(rows, table, ["k"], most).select("k", "id", "v").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_state_survives_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "STATE.json")
    assert session.read_json(spark, path, "none") == "none"
    for k in range(5):
        session.write_json(spark, path, {"n": k, "s": "ü"})
    assert session.read_json(spark, path) == {"n": 4, "s": "ü"} and len([p for p in (tmp_path / "STATE.json").iterdir() if p.name.isdigit()]) == 2

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(session, "_rename", stop)
        with pytest.raises(KeyboardInterrupt):
            session.write_json(spark, path, "lost")
    assert session.read_json(spark, path) == {"n": 4, "s": "ü"}
    with monkeypatch.context() as m:
        m.setattr(session, "_versions", lambda *_: [3])  # another job has written version 4 meanwhile
        with pytest.raises(FileExistsError):
            session.write_json(spark, path, "late")
    assert session.read_json(spark, path) == {"n": 4, "s": "ü"}
    session.write_json(spark, path, 6)
    assert session.read_json(spark, path) == 6


def test_a_workspace_leaves_nothing(spark):
    with session.workspace(spark) as path:
        df = session.settled(spark.range(5))
        assert df.count() == 5 and df.inputFiles()[0].count(path.rsplit("/", 1)[1])
    fs, p = session._file(spark, path)
    assert not fs.exists(p)
