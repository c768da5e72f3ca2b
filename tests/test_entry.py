"""The entry points with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry_points
from attestor.plans import oracles
from attestor.plans import queries as registry


def test_every_own_query_is_registered_with_its_check():
    assert set(registry.registered()) <= set(entry_points.queries())
    assert set(oracles.all_checks()) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_points_work_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry_points)
        assert set(bare.queries()) == set(registry.registered())
        assert set(bare.oracle_sql()) == set(oracles.all_checks())
    finally:
        monkeypatch.undo()
        importlib.reload(entry_points)


def test_nothing_else_imports_the_subpackage():
    assert not [m for m in (registry, oracles) if "attestor.llm" in open(m.__file__).read()]
