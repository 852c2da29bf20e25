import importlib.util
import sys

import pytest

import __spark_entry__ as entry


def test_queries_and_sql_match():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 60


def test_entry_runs_without_the_llm_subpackage(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "corpusloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import corpusloom

    monkeypatch.delattr(corpusloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    module = importlib.reload(entry)
    assert not any(n.startswith("op") or n == "pipeline" for n in module.queries())


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "corpusloom.llm" not in p.read_text(encoding="utf-8"), p


@pytest.mark.skipif(importlib.util.find_spec("corpusloom.llm") is None, reason="without the subpackage nothing asks for the library")
def test_entry_runs_without_a_library_that_only_the_llm_subpackage_needs(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "xxhash":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m in ("corpus_pipeline", "xxhash") or m.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import corpusloom

    monkeypatch.delattr(corpusloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    module = importlib.reload(entry)
    with pytest.warns(UserWarning, match="xxhash"):
        assert len(module.queries()) > 60
