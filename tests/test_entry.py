from __future__ import annotations

import re

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "p4_found" in queries


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "hybrid_score" in df.columns


def test_top_k_needs_no_full_sort(spark, data):
    plan = entry.queries()["vector_topk"](spark, data)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = entry.queries()["metadata_filter"](spark, data)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(md_type,legislation\)", plan) and "vector" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_best_per_key_is_pruned_before_the_shuffle(spark, data):
    plan = entry.queries()["types_title_trgm"](spark, data)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_global_orders_are_no_single_task(spark, data):
    for name in ("natural_sort", "even_partition", "round_robin_partition", "zigzag_order", "gini_sizes", "latency_percentiles"):
        plan = entry.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan, name
