"""Hot keys: a third of all rows in one group, with broadcast disabled and small partitions.
The group must be spread over tasks and no row may be lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import rollups

FORCE_SHUFFLE_AND_SKEW_SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in FORCE_SHUFFLE_AND_SKEW_SPLIT}
    for k, v in FORCE_SHUFFLE_AND_SKEW_SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_events(spark, n=20000):
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("event_time"),
        F.lit("view").alias("event_type"),
        F.when(F.col("id") % 3 == 0, F.lit("hot.k"))
        .otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"), F.lit(".x")))
        .alias("category_code"),
        F.lit("b").alias("brand"),
        (F.col("id") % 97).cast("double").alias("price"),
    )


def test_price_lists_split_hot_group_and_keep_all_rows(skew_session):
    spark = skew_session
    chunks = rollups.price_lists(_hot_events(spark), chunk_rows=500)
    rows = chunks.withColumn("task", F.spark_partition_id()).collect()
    assert sum(len(r.prices) for r in rows) == 20000
    hot = [r for r in rows if r.category == "hot"]
    assert sum(len(r.prices) for r in hot) == 6667
    assert max(len(r.prices) for r in hot) <= 500          # bounded lists
    assert len(hot) <= 14 + 8                               # ceil(6667 / 500) and one short list a task


def test_price_lists_spread_a_hot_group_over_tasks(spark):
    rows = _hot_events(spark).withColumn("price", F.col("event_id").cast("double"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = rollups.price_lists(rows, chunk_rows=500).where("category = 'hot'").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len({r.task for r in hot}) >= 3
    assert sum(len(r.prices) for r in hot) == 6667


def test_funnel_hot_group_counts(skew_session):
    f = rollups.daily_product_funnel(_hot_events(skew_session))
    hot = f.where("category = 'hot'").first()
    assert (hot.view, hot.n_prices) == (6667, 6667)


def test_partitioned_write_spreads_hot_category(skew_session, tmp_dir):
    import os

    from funnelworks.sources import sinks

    spark = skew_session
    rows = spark.range(6000).select(
        F.col("id").alias("event_id"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_interval(days=(F.col("id") % 30).cast("int"))).alias("event_time"),
        F.lit("view").alias("event_type"),
        F.when(F.col("id") % 10 == 0, F.lit("cold.x")).otherwise(F.concat(F.lit("hot."), (F.col("id") % 40).cast("string"))).alias("category_code"),
        (F.col("id") % 7).cast("string").alias("brand"),
        F.lit(1.0).alias("price"),
    )
    funnel = rollups.daily_product_funnel(rows)
    path = sinks.write_partitioned(funnel, f"{tmp_dir}/rollup", "category", ["event_day", "classification", "brand"])
    hot_files = [f for f in os.listdir(f"{path}/category=hot") if f.endswith(".parquet")]
    assert len(hot_files) > 1                               # several writers for the hot category
    back = sinks.read_back(spark, path, schema=funnel.schema)
    assert back.count() == funnel.count()
