"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows, and its own test says which."""

from __future__ import annotations

import pytest
from compare import rows

from granary.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_one_scan_serves_the_dashboard(spark, sf_dir):
    plan = QUERIES["q_usage_dashboard"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan


@pytest.mark.parametrize("name", ["q_lexical_topk", "q_vector_topk", "q_vector_filtered"])
def test_retrieval_has_no_cartesian_product(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["q_usage_by_model"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "props" not in plan


def test_only_small_tables_are_dealt_out(spark, sf_dir, monkeypatch):
    from granary.sources import tables

    plan = lambda: QUERIES["q_sections"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, QUERIES["q_chunks"](spark, sf_dir).collect()))
    assert plan().count("Exchange hashpartitioning(doc_id") == 1 and "REPARTITION_BY_NUM" in plan()
    monkeypatch.setattr(tables, "SPREAD", 0)
    assert "REPARTITION_BY_NUM" not in plan()
    assert sorted(map(str, QUERIES["q_chunks"](spark, sf_dir).collect())) == want


@pytest.mark.parametrize("name", ["q_headings", "q_sections", "q_sections_merged", "q_render_html"])
def test_no_line_leaves_its_document(name, spark, sf_dir):
    """Small tables are dealt out once; nothing else is shuffled."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
