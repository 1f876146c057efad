"""The plan properties the design relies on, checked on the executed (AQE) plans."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE_DIR


def _plan(spark, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _final(plan):
    return plan.split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("name,column", [
    ("overview_pivot", "ts"), ("overview_counts", "ts"), ("daily_sales", "l_shipdate"),
    ("sales_total", "l_shipdate"),
])
def test_range_predicate_reaches_the_scan(spark, name, column):
    plan = _plan(spark, name)
    assert re.search(rf"PushedFilters: \[.*GreaterThanOrEqual\({column},.*LessThan\({column},", plan)


def test_pivot_is_one_aggregation_exchange(spark):
    final = _final(_plan(spark, "overview_pivot"))
    aggregates = re.findall(r"HashAggregate \(", final)
    assert len(aggregates) == 2          # partial + final, no second pivot aggregation


def test_sales_change_scans_once_without_join(spark):
    plan = _plan(spark, "sales_change")
    assert _final(plan).count("Scan parquet") == 1
    assert "Join" not in _final(plan)


def test_category_read_lists_its_folder_alone(spark):
    plan = _plan(spark, "category_statistics")
    assert re.search(r"Location: InMemoryFileIndex \[\S*/category=medium\]", plan), plan


def test_first_event_is_top_one(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "first_event")


def test_dense_overview_broadcasts_the_bounded_pivot(spark):
    assert "BroadcastHashJoin LeftOuter" in _final(_plan(spark, "overview_dense"))


def test_funnel_reads_only_needed_columns(spark):
    plan = _plan(spark, "daily_product_funnel")
    schema = re.search(r"events\.parquet\]\n(?:.*\n)*?ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "user_id" not in schema and "event_id" not in schema
