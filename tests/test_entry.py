import importlib

import pytest


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "rank", "selected"] and df.count() > 0


def test_core_queries_stand_without_the_others(monkeypatch):
    import sys

    entry = importlib.import_module("__spark_entry__")
    everything = set(entry.queries())
    for name in [m for m in sys.modules if m == "quern.llm" or m.startswith("quern.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quern.llm", None)  # it is there, but can't be imported
    core = set(entry.queries())
    assert core <= everything and len(core) > 80 and set(entry.oracle_sql()) <= core
