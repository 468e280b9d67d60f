import importlib
import sys

import __spark_entry__


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("panelforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "panelforge.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    entry = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op") for n in entry.queries()) and "pipeline" not in entry.queries()
