import importlib
import sys


def test_queries_and_sql_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10


def test_everything_else_imports_without_the_llm_folders(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("dustline.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "dustline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
