"""Physical plans keep their shape: no nested loops, pruned scans, partial aggregates."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import quality
from tablewright.plans import registry

FOLDER = "/root/testdata/sf0.001"
LAZY = ("quality_scorecard", "column_profile", "case_variants", "duplicate_rows", "reconcile_inventory", "rule_compliance", "union_records", "window_metrics")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned(spark):
    table = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_quantity", "l_discount").where(F.col("l_shipdate") > "1996-01-01")
    text = plan(quality.scorecard(table))
    assert "l_comment" not in text and "l_tax" not in text and "PushedFilters: [IsNotNull(l_shipdate)" in text


def test_every_query_has_a_check():
    assert not set(registry.QUERIES) - set(registry.CHECKS)
