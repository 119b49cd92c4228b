import importlib
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["scan_run_id", "path_key", "change"]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("p2", "p3", "p4", "p6", "p7", "p8"))])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from collections import Counter

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    q = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in q.description]
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(map(plain, r)) for r in q.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want


def test_the_rest_works_without_the_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "stratafile.llm", None)
    monkeypatch.delitem(sys.modules, "stratafile.llm.queries", raising=False)
    plain = importlib.reload(entry)
    names = set(plain.queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert "p1_found" in names and "p2_found" not in names
