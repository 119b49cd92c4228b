import random
import re
from collections import Counter

from stratafile.llm.frequency import ALL, MERGED, TermCounts


def row(i, ext=None, state=None, code=None):
    return {"file_id": i, "ext": ext, "state": state, "error_code": code}


def brute(rows):
    occ, recs = Counter(), Counter()
    for r in rows:
        terms = [(f, v) for f in ("ext", "state") if (v := (r[f] or "").strip().lower())]
        terms += [("error_code", t) for t in re.findall("[a-z0-9_]+", (r["error_code"] or "").lower())]
        occ.update(terms)
        recs.update(set(terms))
    mark = lambda k: "rare" if occ[k] < 6 else "common" if recs[k] * 10 > len(rows) else "mid"
    return sorted((*k, occ[k], recs[k], mark(k)) for k in occ)


def found(counts):
    return sorted(tuple(r) for r in counts.marked().collect())


def some(rng, n):
    return [row(i, rng.choice([None, "", " .PDF", ".pdf", ".x", "\t"]), rng.choice(["done", "Done ", None, f"s{rng.randrange(9)}"]), rng.choice([None, "a;a|B", "a", "b, c_1 / a", "--", f"z{rng.randrange(30)}"])) for i in range(n)]


def counts(spark):
    return TermCounts(spark, ["ext", "state"], ["error_code"])


def test_all_at_once_and_by_signed_changes(spark, make_files):
    rng = random.Random(2)
    rows = some(rng, 300)
    c = counts(spark)
    c.apply(added=make_files(*rows))
    assert found(c) == brute(rows)
    gone, changed, new = rows[:40], rows[40:80], some(rng, 60)
    became = some(rng, 40)
    c.apply(added=make_files(*new, *became), removed=make_files(*gone, *changed))
    assert found(c) == brute(rows[80:] + new + became)
    c.apply(removed=make_files(*rows[80:], *new, *became))
    assert found(c) == [] and c.counts().count() == 0


def test_occurrences_and_records(spark, make_files):
    c = counts(spark)
    c.apply(added=make_files(*(row(i, code="Process;process|x") for i in range(3))))
    assert {(r.val, r.occ, r.recs, r.mark) for r in c.marked().collect()} == {("process", 6, 3, "common"), ("x", 3, 3, "rare")}
    assert c.counts().where(f"field = '{ALL}'").first().recs == 3


def test_empty_long_and_clashing(spark, make_files):
    c = counts(spark)
    assert found(c) == []
    c.apply(added=make_files())
    assert found(c) == []
    long = row(1, "." + "e" * 50_000, "s", "tok " * 20_000)
    c.apply(added=make_files(long, long).selectExpr("*", "1 AS EXT", "2 AS _sign", "3 AS field", "4 AS val"))
    assert found(c) == brute([long, long])


def test_counts_are_taken_up_again(spark, make_files, tmp_path):
    rng = random.Random(8)
    rows, more = some(rng, 50), some(rng, 20)
    at = lambda: TermCounts(spark, ["ext", "state"], ["error_code"], str(tmp_path / "terms"))
    at().apply(added=make_files(*rows))
    at().apply(added=make_files(*more))
    assert len(at().state["segments"]) == 2 and found(at()) == brute(rows + more)
    at().drop()
    assert found(at()) == [] and not (tmp_path / "terms").exists()


def test_a_delivery_counts_once_and_writes_what_it_changes(spark, make_files, tmp_path):
    rng = random.Random(4)
    c = TermCounts(spark, ["ext", "state"], ["error_code"], str(tmp_path / "terms"), least_rows=8)
    size = lambda: {p: p.stat().st_size for p in (tmp_path / "terms").rglob("*.parquet")}
    rows = []
    for k in range(9):
        new = some(rng, 30)
        assert c.apply(added=make_files(*new), delivery=f"d{k}")
        assert not c.apply(added=make_files(*new), delivery=f"d{k}")
        rows += new
        assert found(c) == brute(rows) and len(c.state["segments"]) < 2 * MERGED
    large = [row(i, f".{i}", "s") for i in range(4000)]
    c = TermCounts(spark, ["ext", "state"], ["error_code"], str(tmp_path / "terms"))
    c.apply(added=make_files(*large), delivery="large")
    before = size()
    c.apply(added=make_files(row(1, ".new", "s")), delivery="small")
    written = {p: n for p, n in size().items() if p not in before}
    assert len(before.keys() - size().keys()) == 0 and sum(written.values()) < 0.2 * sum(before.values())
    assert found(c) == brute([*rows, *large, row(1, ".new", "s")])
