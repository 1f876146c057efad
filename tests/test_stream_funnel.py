"""The funnel over event time: closed days, late events, restarts, published versions."""

import datetime as dt

from pyspark.sql import functions as F

from funnelworks.operators import rollups
from funnelworks.sources import sinks
from funnelworks.streaming import funnel

COLUMNS = "event_time timestamp_ntz, event_type string, category_code string, brand string, price double"


def _at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def _land(spark, path, rows):
    funnel.land_events(spark.createDataFrame(rows, COLUMNS), path)


def _run(spark, root, delay="1 day"):
    query = funnel.append_days(funnel.event_files(spark, f"{root}/events"), f"{root}/days", f"{root}/ck", delay)
    query.awaitTermination()
    return query


def _days(spark, root):
    return {(r.event_day.day, r.classification): (r.view, r.n_prices) for r in funnel.read_days(spark, f"{root}/days").collect()}


def test_days_close_with_the_watermark(spark, tmp_dir):
    _land(spark, f"{tmp_dir}/events", [(_at(1, 5), "view", "a.x", "b", 1.0), (_at(2, 1), "cart", "a.x", "b", None), (_at(1, 6), "view", None, "b", 1.0)])
    _run(spark, tmp_dir)
    assert _days(spark, tmp_dir) == {}                       # the watermark stands at 1 January, 01:00
    # an event of 1 January is still in time
    _land(spark, f"{tmp_dir}/events", [(_at(1, 23), "view", "a.x", "b", 2.0), (_at(3, 1), "view", "a.y", "b", 2.0)])
    _run(spark, tmp_dir)
    assert _days(spark, tmp_dir) == {(1, "x"): (2, 2)}
    # 1 January is closed now; 2 January is not
    _land(spark, f"{tmp_dir}/events", [(_at(1, 1), "view", "a.x", "b", 9.0), (_at(2, 1), "view", "a.x", "b", 9.0), (_at(9), "view", "a.z", "b", 1.0)])
    query = _run(spark, tmp_dir)
    assert funnel.late_events(query) == 1
    assert _days(spark, tmp_dir) == {(1, "x"): (2, 2), (2, "x"): (1, 2), (3, "y"): (1, 1)}
    _run(spark, tmp_dir)                                     # nothing new: nothing is written again
    assert len(_days(spark, tmp_dir)) == funnel.read_days(spark, f"{tmp_dir}/days").count() == 3


def test_a_longer_delay_keeps_days_open(spark, tmp_dir):
    _land(spark, f"{tmp_dir}/events", [(_at(1), "view", "a.x", "b", 1.0), (_at(5), "view", "a.x", "b", 1.0)])
    _run(spark, tmp_dir, "10 days")
    _land(spark, f"{tmp_dir}/events", [(_at(1, 3), "view", "a.x", "b", 1.0), (_at(30), "view", "a.x", "b", 1.0)])
    query = _run(spark, tmp_dir, "10 days")
    assert funnel.late_events(query) == 0
    assert _days(spark, tmp_dir) == {(1, "x"): (2, 2), (5, "x"): (1, 1)}


def test_totals_equal_the_batch_rollup_after_every_arrival(spark, tmp_dir):
    rows = [(_at(1 + i % 4, i % 24), ("view", "cart", "purchase")[i % 3], f"c{i % 2}.k", None if i % 5 else "b", float(i)) for i in range(60)]
    for upto in (30, 60):
        _land(spark, f"{tmp_dir}/events", rows[upto - 30 : upto])
        funnel.publish_totals(funnel.event_files(spark, f"{tmp_dir}/events"), f"{tmp_dir}/totals", f"{tmp_dir}/ck").awaitTermination()
        want = rollups.daily_product_funnel(spark.createDataFrame(rows[:upto], COLUMNS))
        got = sinks.read_version(spark, f"{tmp_dir}/totals", funnel.FUNNEL_SCHEMA).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_versions_switch_whole(spark, tmp_dir):
    root = f"{tmp_dir}/table"
    for n in range(4):
        sinks.publish_version(spark.range(n + 1), root, f"v{n}")
        assert sinks.read_version(spark, root).count() == n + 1
    # the version before the current one is still there for its readers
    assert spark.read.parquet(f"{root}/versions/v2").count() == 3
    sinks.publish_version(spark.range(9), root, "v3")        # a batch that is run again
    assert sinks.read_version(spark, root).count() == 9
    assert sinks.current_version(spark, f"{tmp_dir}/none") is None


def test_a_hot_group_is_combined_before_the_state(spark, tmp_dir):
    rows = spark.range(0, 30_000, 1, 6).select(
        F.lit(_at(1)).cast("timestamp_ntz").alias("event_time"), F.lit("view").alias("event_type"),
        F.lit("hot.k").alias("category_code"), F.lit("b").alias("brand"), F.lit(1.0).alias("price"),
    )
    funnel.land_events(rows, f"{tmp_dir}/events")
    _land(spark, f"{tmp_dir}/events", [(_at(20), "view", "z", None, None)])
    query = _run(spark, tmp_dir)
    assert _days(spark, tmp_dir) == {(1, "k"): (30_000, 30_000)}
    assert max(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]) == 2
