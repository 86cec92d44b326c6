import importlib
import pathlib
import re
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_core_imports_the_training_data_operators():
    for path in (ROOT / "chainloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_the_entry_works_without_them(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("chainloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "chainloom.llm", None)
    package = importlib.import_module("chainloom")
    monkeypatch.delattr(package, "llm", raising=False)
    names = set(entry.queries())
    assert "p1_found" in names and "p3_found" not in names and set(entry.oracle_sql()) <= names


def test_flagship_query(spark):
    assert entry.entry(spark).columns == ["sample_id", "total", "exclusive", "shared", "conserved"]
