import os
import random

import pytest

from stratafile.llm import history
from stratafile.llm.history import HistoryIndex

SHA = [f"{i:02x}" * 32 for i in range(1, 40)]
SHA = [s[:-2] + "9a" for s in SHA]
QUICK = [f"{i:02x}" * 7 + "9a" for i in range(1, 40)]


def row(i, sha=None, quick=None, size=10, ext=".pdf", state="done"):
    return {"file_id": i, "sha256": sha, "quick_hash": quick, "size_bytes": size, "ext": ext, "state": state}


def brute(history, batch):
    """Match by match, as the problem states it."""

    def valid(x, lengths):
        x = (x or "").strip().lower()
        return x if len(x) in lengths and set(x) <= set("0123456789abcdef") and len(set(x)) > 1 else None

    def keys(r):
        s = (r["state"] or "").strip().lower()
        if s in ("error", "missing", "") or not r["size_bytes"] or r["size_bytes"] <= 0:
            return None, None
        q = valid(r["quick_hash"], (16, 40))
        return valid(r["sha256"], (64,)), q and (q, r["size_bytes"], (r["ext"] or "").strip().lower())

    out = []
    for r in batch:
        x, y = keys(r)
        before = [keys(h) + (h["file_id"],) for h in history] + [keys(b) + (b["file_id"],) for b in batch if b["file_id"] < r["file_id"]]
        exact = [i for a, _, i in before if x and a == x]
        near = [i for _, b, i in before if y and b == y]
        if exact or near:
            out.append((min(exact or near), r["file_id"], "exact" if exact else "near"))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("match_id", "file_id", "kind").collect())


def test_kinds_and_dirt(spark, make_files):
    history = [row(1, SHA[0], QUICK[0]), row(2, None, QUICK[1]), row(3, "0" * 64, "a" * 16), row(4, SHA[2], state="error"), row(5, SHA[3], size=0), row(6, SHA[4], QUICK[4], ext=None)]
    batch = [
        row(10, f" {SHA[0].upper()}\n"), row(11, SHA[9], QUICK[1], ext=" .PDF"), row(12, None, QUICK[1], size=11), row(13, "0" * 64, "a" * 16), row(14, SHA[2]), row(15, SHA[3]),
        row(16, None, QUICK[4], ext=" "), row(17, SHA[9], QUICK[9]), row(18, SHA[9], state=" Missing "), row(19, None, None, None, None, None), row(20, SHA[0], QUICK[1]),
    ]
    index = HistoryIndex(spark)
    index.append(make_files(*history))
    got = found(index.deliver(make_files(*batch)))
    assert got == brute(history, batch)
    assert (1, 10, "exact") in got and (2, 11, "near") in got and (6, 16, "near") in got and (11, 17, "exact") in got and (1, 20, "exact") in got


@pytest.mark.parametrize("deliveries", [1, 4])
def test_batch_after_batch_equals_all_at_once(spark, make_files, deliveries):
    rng = random.Random(deliveries)
    pick = lambda values: rng.choice([None, "", *values[:12]])
    rows = [row(i, SHA[0] if rng.random() < 0.3 else pick(SHA), pick(QUICK), rng.choice([0, 5, 6]), rng.choice([None, ".A", ".a "]), rng.choice(["done", "error", "Done"])) for i in range(240)]
    history, batch = rows[:120], rows[120:]
    index = HistoryIndex(spark, merged=2, least_rows=20)
    index.append(make_files(*history))
    size, got = len(batch) // deliveries, []
    for k in range(deliveries):
        got += found(index.deliver(make_files(*batch[k * size : (k + 1) * size])))
    assert sorted(got) == brute(history, batch)
    assert len(index.segments) <= 4
    at = index.path.removeprefix("file:")
    assert os.path.exists(at)
    index.drop()
    assert not os.path.exists(at)


def test_a_hot_digest_is_broadcast(spark, make_files):
    batch = [row(100 + i, SHA[1] if i % 3 else SHA[2 + i % 30], None) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = HistoryIndex(spark)
        index.append(make_files(row(1, SHA[1])))
        got = found(index.probe(make_files(*batch)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {}
    want = []
    for r in [row(1, SHA[1]), *batch]:
        if r["sha256"] in first:
            want.append((first[r["sha256"]], r["file_id"], "exact"))
        first.setdefault(r["sha256"], r["file_id"])
    assert got == sorted(want)


def test_empty_tables_long_texts_and_clashing_columns(spark, make_files):
    index = HistoryIndex(spark)
    index.append(make_files())
    assert found(index.deliver(make_files())) == []
    batch = make_files(row(1, SHA[0], "x" * 100_000, ext="y" * 100_000), row(2, SHA[0]), row(None, SHA[0]), row(2, SHA[0]))
    clash = batch.selectExpr("*", "'a' AS SHA256", "1 AS token", "2 AS length", "3 AS first_id", "4 AS digest")
    assert set(found(index.deliver(clash))) == {(1, 2, "exact")}


def test_an_index_is_taken_up_again(spark, make_files, tmp_path):
    path = str(tmp_path / "index")
    first = HistoryIndex(spark, path, buckets=3)
    first.append(make_files(row(1, SHA[0])))
    first.append(make_files(row(2, SHA[1])))
    for name in first.segments:
        spark.sql(f"DROP TABLE {name['name']}")  # as in a new session
    again = HistoryIndex(spark, path)
    assert again.state["buckets"] == 3 and len(again.segments) == 2
    assert found(again.deliver(make_files(row(5, SHA[1]), row(6, SHA[0])))) == [(1, 6, "exact"), (2, 5, "exact")]
    plan = again.probe(make_files(row(7, SHA[0])))
    assert found(plan) == [(1, 7, "exact")]


def test_the_rarest_token_is_the_prefix(spark, monkeypatch):
    """A quick hash of most records is commoner than some sizes; a size that most share never is the prefix."""
    monkeypatch.setattr(history, "COMMON", 5)
    rows = [("qa", i, ".x") for i in range(50)] + [(f"q{i}", 7, ".x") for i in range(50)] + [("s1", -1, "")]
    records = spark.createDataFrame(rows, "digest string, length long, ext string")
    common = {r.token: r.df for r in history.common_tokens(records).collect()}
    assert common == {"qa": 50, "z7": 51, "e.x": 100}
    got = {(r.digest, r.length): r.token for r in history.with_prefix(records, history.common_tokens(records)).collect()}
    assert got["qa", 3] == "z3" and got["qa", 7] == "qa" and got["q9", 7] == "q9" and got["s1", -1] == "s1"
    assert {r.token for r in history.with_prefix(records, None).collect()} == {d for d, _, _ in rows}


def test_rarity_changes_as_the_index_grows(spark, make_files, monkeypatch):
    monkeypatch.setattr(history, "COMMON", 4)
    rng = random.Random(9)
    rows = [row(i, None, QUICK[0] if rng.random() < i / 200 else rng.choice(QUICK), rng.randrange(1, 6), rng.choice([".a", ".b"])) for i in range(200)]
    index = HistoryIndex(spark, least_rows=5)
    got, sizes = [], []
    for start in (0, 10, 20, 60, 100):
        end = {0: 10, 10: 20, 20: 60, 60: 100, 100: 200}[start]
        got += found(index.deliver(make_files(*rows[start:end])))
        sizes.append(index.state["ordered_at"])
    assert sorted(got) == brute([], rows) and sizes[-1] > sizes[0]
    index.drop()


def test_retracted_rows_no_longer_match(spark, make_files):
    history_rows = [row(1, SHA[0], QUICK[0]), row(2, SHA[0], QUICK[0]), row(3, SHA[1], QUICK[1]), row(4, SHA[2]), *(row(10 + i, SHA[3]) for i in range(5))]
    gone, left = [r for r in history_rows if r["file_id"] in (1, 3, 10)], [r for r in history_rows if r["file_id"] not in (1, 3, 10)]
    batch = [row(100 + i, SHA[i], QUICK[i]) for i in range(4)]
    index = HistoryIndex(spark, merged=3, least_rows=1)
    index.append(make_files(*history_rows))
    index.retract(make_files(*gone), make_files(*left))
    assert found(index.probe(make_files(*batch))) == brute(left, batch)
    index.append(make_files(row(50, SHA[1])))
    assert (50, 101, "exact") in found(index.probe(make_files(*batch)))
    for k in range(4):  # merged with what was retracted
        index.append(make_files(row(60 + k, SHA[9 + k])))
    again = HistoryIndex(spark, index.path)
    assert found(again.probe(make_files(*batch))) == brute([*left, row(50, SHA[1])], batch)
    index.drop()
