"""Rollups kept up to date, sales of a stream, exact sums, times drawn from rows."""

import datetime as dt
import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import incremental, listings, rollups, sales
from funnelworks.operators.exact_sum import exact_sum
from funnelworks.sources import sinks

EVENTS = "event_id bigint, event_time timestamp_ntz, event_type string, category_code string, brand string, price double"


def _events(spark, n, seed, days=(1, 6)):
    rng = random.Random(seed)
    rows = [
        (i, dt.datetime(2024, 1, rng.randint(*days), rng.randint(0, 23)), rng.choice(["view", "cart", "purchase", "x"]),
         rng.choice(["a.k", "b.k", "b.l", "", None, "~z"]), rng.choice(["p", None]), rng.choice([None, float(rng.randint(1, 99))]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, EVENTS)


def _same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_slices_add_up_to_the_full_funnel(spark, tmp_dir):
    slices = [_events(spark, 200, 1, (1, 3)), _events(spark, 100, 2, (3, 5)), _events(spark, 50, 3, (2, 2)), _events(spark, 0, 4)]
    everything = slices[0]
    assert incremental.read_rollup(spark, f"{tmp_dir}/r").count() == 0
    for n, part in enumerate(slices):
        assert incremental.apply_slice(part, f"{tmp_dir}/r", f"s{n}")
        everything = everything.unionByName(part) if n else part
        _same(incremental.read_rollup(spark, f"{tmp_dir}/r"), rollups.daily_product_funnel(everything))
    before = sinks.current_version(spark, f"{tmp_dir}/r/manifest")
    assert not incremental.apply_slice(slices[1], f"{tmp_dir}/r", "s1")
    assert sinks.current_version(spark, f"{tmp_dir}/r/manifest") == before
    assert {r.slice for r in incremental.applied_slices(spark, f"{tmp_dir}/r").collect()} == {"s0", "s1", "s2", "s3"}
    with pytest.raises(ValueError):
        incremental.apply_slice(slices[0], f"{tmp_dir}/r", "../up")


def test_only_touched_partitions_are_written(spark, tmp_dir):
    root = f"{tmp_dir}/r"
    incremental.apply_slice(_events(spark, 300, 1, (1, 9)), root, "old")
    incremental.apply_slice(_events(spark, 40, 2, (4, 4)).where("category_code = 'b.k'"), root, "new")
    assert sorted(os.listdir(f"{root}/data/slice=new/folder_category=b")) == ["folder_day=2024-01-04"]
    assert [f for f in os.listdir(f"{root}/data/slice=new") if f.startswith("folder")] == ["folder_category=b"]


def test_a_slice_that_stopped_half_way_is_run_again(spark, tmp_dir, monkeypatch):
    root, first, second = f"{tmp_dir}/r", _events(spark, 80, 1), _events(spark, 60, 2)
    incremental.apply_slice(first, root, "a")

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(sinks, "publish_version", stop)
        with pytest.raises(RuntimeError):
            incremental.apply_slice(second, root, "b")
    _same(incremental.read_rollup(spark, root), rollups.daily_product_funnel(first))
    incremental.apply_slice(second, root, "b")
    _same(incremental.read_rollup(spark, root), rollups.daily_product_funnel(first.unionByName(second)))


def test_vacuum_drops_slices_that_nothing_names(spark, tmp_dir):
    root, part = f"{tmp_dir}/r", _events(spark, 80, 1, (1, 1))
    incremental.apply_slice(part, root, "a")
    incremental.apply_slice(part, root, "b")                 # touches all of a's partitions
    before = incremental.read_rollup(spark, root).collect()
    assert incremental.vacuum(spark, root) == ["a"]
    assert sorted(map(repr, incremental.read_rollup(spark, root).collect())) == sorted(map(repr, before))
    assert not incremental.apply_slice(part, root, "a")      # still known as applied


# --- sales of a stream


LISTINGS = "timestamp timestamp_ntz, price double"


def _listings(spark, n, seed):
    rng = random.Random(seed)
    rows = [(dt.datetime(2024, 1, rng.randint(1, 4)), rng.choice([None, rng.uniform(0, 1000), rng.uniform(0, 1e-9), 1e17])) for _ in range(n)]
    return spark.createDataFrame(rows, LISTINGS)


def _days(frame):
    return {r.day: r.sales for r in frame.collect()}


def test_a_replayed_batch_is_not_added_twice(spark, tmp_dir):
    everything = _listings(spark, 300, 1)
    everything.repartition(3).write.parquet(f"{tmp_dir}/in")
    source = lambda: spark.readStream.schema(LISTINGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    stopped = []

    def fold(batch, batch_id):
        sales.fold_batch(batch, f"{tmp_dir}/sales", batch_id)
        if batch_id == 1 and not stopped:
            stopped.append(batch_id)
            raise RuntimeError("stopped after the write, before the commit")

    for _ in range(2):
        query = source().writeStream.foreachBatch(fold).option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001 - the stop above
            assert "stopped after the write" in str(e)
    assert stopped == [1]
    want = _days(sales.daily_sales(everything))
    assert _days(sales.read_folded(spark, f"{tmp_dir}/sales")) == want
    sales.compact_sales(spark, f"{tmp_dir}/sales")
    assert os.listdir(f"{tmp_dir}/sales/batches") == []
    sales.fold_batch(everything, f"{tmp_dir}/sales", 2)      # folded in: left alone
    assert _days(sales.read_folded(spark, f"{tmp_dir}/sales")) == want
    sales.fold_batch(_listings(spark, 50, 2), f"{tmp_dir}/sales", 3)
    assert _days(sales.read_folded(spark, f"{tmp_dir}/sales")) == _days(sales.daily_sales(everything.unionByName(_listings(spark, 50, 2))))


# --- exact sums


def test_sums_equal_fractions_in_any_partitioning(spark):
    rng = random.Random(1)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-300, 290), lambda: 5e-324, lambda: 1e290 * rng.choice([1, -1]),
             lambda: 0.1, lambda: -0.0, lambda: rng.choice([1, -1]) * 2.0 ** rng.randint(-1074, 900)]
    rows = [(i % 7, rng.choice(kinds)() if i % 7 < 6 else rng.choice([1e16, 1.0, -1e16, 1e-5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = {k: float(sum(Fraction(v) for j, v in rows if j == k)) for k in range(7)}
    for parts in (1, 8, 61):
        assert {r.k: r.s for r in exact_sum(df.repartition(parts), [F.col("k")], F.col("v"), "s").collect()} == want


def test_sums_of_odd_values(spark):
    inf = math.inf
    rows = [(1, None), (2, inf), (2, 1.0), (3, inf), (3, -inf), (4, math.nan), (5, -inf), (6, None), (6, 2.5), (7, -0.0), (8, 1e308), (8, 1e308)]
    got = {r.k: (r.s, r.n) for r in exact_sum(spark.createDataFrame(rows, "k int, v double"), [F.col("k")], F.col("v"), "s", "n").collect()}
    assert math.isnan(got[3][0]) and math.isnan(got[4][0])
    assert {k: v for k, v in got.items() if k not in (3, 4)} == {1: (0.0, 1), 2: (inf, 2), 5: (-inf, 1), 6: (2.5, 2), 7: (0.0, 1), 8: (inf, 2)}
    assert exact_sum(spark.createDataFrame([], "k int, v double"), [F.col("k")], F.col("v"), "s").count() == 0


# --- times drawn from rows


def test_random_times_do_not_depend_on_partitions(spark):
    start, end = dt.datetime(2024, 5, 1), dt.datetime(2024, 7, 12, 23, 59, 59)
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 5).alias("kind"))
    stamps = [
        sorted(map(tuple, listings.random_stamp(rows.repartition(n), start, end, 3).collect())) for n in (1, 8, 211)
    ]
    assert stamps[0] == stamps[1] == stamps[2]
    other = sorted(map(tuple, listings.random_stamp(rows, start, end, 4).collect()))
    assert sum(a == b for a, b in zip(stamps[0], other, strict=True)) < 5


def test_random_times_are_uniform(spark):
    start, end = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 4, 23, 59, 59)
    n, cells = 40_000, 96
    hours = listings.random_stamp(spark.range(n), start, end, 1).groupBy(F.date_trunc("hour", "timestamp")).count().collect()
    chi = sum((r["count"] - n / cells) ** 2 / (n / cells) for r in hours)
    assert len(hours) == cells and 50 < chi < 160            # 95 degrees of freedom
    draws = spark.range(n).select(*[(listings.draw([F.col("id")], 1, c) % 4).alias(f"d{c}") for c in (0, 1)])
    pairs = draws.groupBy("d0", "d1").count().collect()
    assert len(pairs) == 16 and sum((r["count"] - n / 16) ** 2 / (n / 16) for r in pairs) < 45
