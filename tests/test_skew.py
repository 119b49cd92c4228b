import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratafile.operators.skew import balanced_aggregate, balanced_rank, heavy_keys


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(6000):
        k = 7 if rng.random() < 0.4 else rng.choice([None, 1, 2, 3, rng.randrange(500)])
        out.append((k, rng.choice(["", ".a", ".b", None]) if k != 7 else ".a", i, rng.choice([None, i % 13]), float(i % 7)))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_aggregate_against_brute_force(spark, rows, partitions):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(rows, "k long, e string, i long, v int, w double")
        out = balanced_aggregate(df, ["k", "e"], ["i"], ["v", "w"], partitions)
        got = {(r.k, r.e): (r.n, r.v_sum, r.v_min, r.v_max, r.w_sum) for r in out.collect()}
        assert out.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for k, e, _, v, w in rows:
        want[k, e].append((v, w))
    for key, values in want.items():
        v = [x for x, _ in values if x is not None]
        assert got[key] == (len(values), sum(v) if v else None, min(v, default=None), max(v, default=None), sum(w for _, w in values))
    assert len(got) == len(want)


def test_heavy_keys_are_split(spark, rows):
    df = spark.createDataFrame(rows, "k long, e string, i long, v int, w double")
    parts = df.repartitionByRange(8, "k", "e", "i").withColumn("p", F.spark_partition_id())
    assert parts.where("k = 7").select("p").distinct().count() > 2
    got = {(r.k, r.e) for r in heavy_keys(df, ["k", "e"], ["i"], 1).collect()}
    n = Counter((k, e) for k, e, *_ in rows)
    assert got == {x for x, c in n.items() if c * 100 >= len(rows)}


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_rank_against_brute_force(spark, rows, partitions):
    df = spark.createDataFrame(rows, "k long, e string, i long, v int, w double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {r.i: r["rank"] for r in balanced_rank(df, ["k", "e"], [F.desc("w"), F.asc("i")], partitions=partitions).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for k, e, i, _, w in rows:
        by[k, e].append((-w, i))
    want = {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own), 1)}
    assert got == want


def test_empty_ties_and_one_key(spark):
    schema = "k long, e string, i long"
    empty = spark.createDataFrame([], schema)
    assert heavy_keys(empty, ["k", "e"], ["i"]).count() == 0
    assert balanced_rank(empty, ["k"], [F.asc("i")]).count() == 0
    same = spark.createDataFrame([(1, None, 1)] * 50, schema)
    assert [tuple(r) for r in balanced_aggregate(same, ["k", "e"], ["i"], partitions=6).collect()] == [(1, None, 50)]
    one = spark.createDataFrame([(1, "x" * 50_000, i) for i in range(50)], schema)
    assert [r.n for r in balanced_aggregate(one, ["k", "e"], ["i"], partitions=9).collect()] == [50]
