import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v)


@pytest.fixture(scope="module")
def tables():
    import os

    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.sql(f"create view {f.split('.')[0]} as select * from '{ROOT}/{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_match_sql(spark, tables):
    from marlstone.plans import registry

    sql = registry.oracle_sql()
    for name, f in registry.queries().items():
        rows = f(spark, ROOT)
        if name not in sql:
            assert rows.count() >= 0
            continue
        want = tables.sql(sql[name])
        assert sorted(rows.columns) == sorted(want.columns), name
        order = [want.columns.index(c) for c in rows.columns]
        assert sorted(tuple(map(plain, r)) for r in rows.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall()), name


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("marlstone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marlstone.llm", None)
    fresh = importlib.reload(entry)
    try:
        assert not any(name[0] == "p" and name[1].isdigit() for name in fresh.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
