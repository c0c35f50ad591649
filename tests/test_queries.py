"""Every query against its checking SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.load())
WRITES_FILES = {
    "media_listing", "manifest_roundtrip", "header_sniff", "feature_cache", "results_roundtrip", "append_results", "key_list",
    "stored_splits", "json_label_files", "incremental_ingest",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, rows, _, _, note = compare(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in NAMES if n not in WRITES_FILES])
def test_plan_has_no_pair_products(spark, name):
    df = catalog.QUERIES[name].run(catalog.Tables(spark, SF))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql_and_reads_tables():
    sql = entry_points.oracle_sql()
    assert set(sql) >= set(NAMES) and set(entry_points.queries()) >= set(NAMES)
    for name, text in ((n, sql[n]) for n in NAMES):
        assert any(re.search(rf"\b{t}\b", text) for t in catalog.TABLES), name


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 5


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["exists_semi"].run(catalog.Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,25)" in plan
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
