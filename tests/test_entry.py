import importlib
import sys

import __spark_entry__ as entry


def test_queries_have_their_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_text_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("culvert.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "culvert.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert bare.queries() and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)
