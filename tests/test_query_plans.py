"""What the plans of the registered queries must and must not contain."""

import re

import pytest

import __spark_entry__  # noqa: F401 (registers queries)
from lakeloom.functions.money import revenue_cents
from lakeloom.catalog import inputs, marts
from lakeloom.catalog.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
LAZY = sorted(set(QUERIES) - {
    # These write tables when called; their reads are plain scans.
    "backfill_resume", "gold_after_products_stream", "gold_incremental_lifetime", "gold_incremental_sales", "load_quality",
    "serving_export_twice", "serving_from_feed", "stream_resent", "backfill_years", "batch_lifetime_value", "batch_top_products", "bronze_orders_roundtrip", "gold_roundtrip",
    "replace_partitions", "scan_pruned", "serving_sorted", "silver_rejects", "stream_all", "stream_scd2", "stream_upsert"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_pairs_no_forced_broadcast(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BroadcastHashJoin" not in text


def test_sales_are_summed_before_the_dimension_is_joined(spark, no_broadcast):
    text = plan(marts.summary(spark, SMALL))
    final_join = text.index("SortMergeJoin")
    assert text.index("HashAggregate") > final_join and "partial_sum" in text


def test_only_needed_columns_are_read(spark):
    text = marts.summary(spark, SMALL)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any("l_tax" in one or "l_linestatus" in one or "o_totalprice" in one for one in schemas)


def test_filters_reach_the_scan(spark):
    df = QUERIES["lookup_existing"](spark, SMALL)
    text = plan(df)
    assert "LessThan(c_acctbal,0.0)" in text and "EqualTo(o_orderpriority,1-URGENT)" in text


def test_orders_are_limited_per_task_before_the_shuffle(spark):
    text = plan(marts.silver_orders(spark, SMALL))
    assert re.search(r"WindowGroupLimit.*Final", text) and re.search(r"WindowGroupLimit.*Partial", text)


def test_decimal_free_sums(spark):
    """Money is summed as whole cents."""
    text = plan(QUERIES["clv"](spark, SMALL))
    assert "partial_sum(" in text
    orders = spark.createDataFrame([(2, 1.5)], "amount int, price double")
    assert orders.select(revenue_cents("amount", "price").alias("x")).dtypes == [("x", "bigint")]


def test_inputs_keep_every_line(spark):
    lines = inputs.table(spark, SMALL, "lineitem").count()
    assert inputs.orders_raw(spark, SMALL).count() == lines
