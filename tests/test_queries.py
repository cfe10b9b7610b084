"""Every query against its SQL, and the entry module."""

from __future__ import annotations

import importlib
import sys

import pytest

from attestra.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_only_approximate_queries_have_no_sql():
    assert QUERIES.keys() - ORACLE_SQL.keys() == {"similar_reports", "aligned_changes"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["corp", "fy", "state", "n_sources"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "__spark_entry__", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(name=name)

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert set(importlib.import_module("__spark_entry__").queries()) == set(QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    from attestra.plans import proxies

    from .conftest import DATA

    plan = proxies.filings(spark, str(DATA), range(1995, 2001))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_fees_and_packs_read_lines_once(spark):
    """What ranks and packs need more than once is written: their last plans shuffle little and scan no lines again."""
    from .conftest import DATA

    plan = QUERIES["peer_fees"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("Exchange hashpartitioning") <= 8
    plan = QUERIES["acceptance_pack"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
