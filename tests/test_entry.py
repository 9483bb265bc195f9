"""The entry module where optional packages are absent."""

import sys

import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("absent", ["public_tokenizers", "carthouse.llm", "carthouse.llm.queries", "corpus_pipeline"])
def test_queries_survive_a_missing_optional_package(monkeypatch, absent):
    for name in [n for n in sys.modules if n.startswith("carthouse.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)  # import raises ModuleNotFoundError
    found = E.queries()
    assert "item_quantity_by_day" in found and "cart_events" in found and "pipeline" not in found
    assert set(E.oracle_sql()) >= {"item_quantity_by_day", "cart_events"}
