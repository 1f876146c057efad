import datetime as dt

from pyspark.sql import functions as F

from funnelworks.operators import rollups

SCHEMA = "event_id bigint, event_time timestamp_ntz, event_type string, category_code string, brand string, price double"


def _events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_funnel_counts_nulls_and_edge_codes(spark):
    ev = _events(spark, [
        (1, _t(1, 1), "view", "electronics.phone", "b1", 10.0),
        (2, _t(1, 2), "cart", "electronics.phone", "b1", None),        # NULL price kept (D2)
        (3, _t(1, 3), "purchase", "electronics.phone", "b1", 12.0),
        (4, _t(1, 4), "signup", "electronics.phone", "b1", 1.0),      # other type -> 0/0/0 (D13)
        (5, _t(1, 5), "view", "electronics", "b1", 3.0),              # no dot -> NULL classification
        (6, _t(1, 6), "view", None, "b1", 3.0),                        # no category -> dropped
        (7, _t(2, 23), "view", "electronics.phone", None, 4.0),       # NULL brand group (D1)
    ])
    out = {(r.event_day.day, r.classification, r.brand): r for r in rollups.daily_product_funnel(ev).collect()}
    g = out[(1, "phone", "b1")]
    assert (g.view, g.cart, g.purchase, g.n_prices, g.n_null_prices) == (1, 1, 1, 4, 1)
    assert (g.min_price, g.max_price) == (1.0, 12.0)
    assert out[(1, None, "b1")].view == 1
    assert out[(2, "phone", None)].n_prices == 1
    assert len(out) == 3


def test_top_categories_split_is_literal_dot(spark):
    ev = _events(spark, [
        (1, _t(1), "view", "a.b.c", "x", 1.0),
        (2, _t(1), "view", "a", "x", 1.0),
        (3, _t(1), "view", "", "x", 1.0),
        (4, _t(1), "view", None, "x", 1.0),
    ])
    assert sorted(r.category for r in rollups.top_categories(ev).collect()) == ["", "a"]


def test_price_lists_chunks_rebuild_full_lists(spark):
    rows = [(i, _t(1 + i % 2), "view", "c.k", "hot", None if i % 5 == 0 else float(i)) for i in range(200)]
    ev = _events(spark, rows)
    chunks = rollups.price_lists(ev, chunk_rows=7)
    by_group = {}
    for r in chunks.collect():
        assert len(r.prices) <= 7 * 3  # bounded by the chunk size (hash spread)
        by_group.setdefault(r.event_day.day, []).extend(r.prices)
    for day in (1, 2):
        expected = [p for (i, t, _, _, _, p) in rows if t.day == day]
        assert sorted(by_group[day], key=lambda x: (x is not None, x)) == sorted(expected, key=lambda x: (x is not None, x))
    assert chunks.select("category", "event_day", "chunk").distinct().count() > 10


def test_funnel_invariants(spark):
    from funnelworks.sources import fixtures
    from tests.conftest import SMOKE_DIR

    ev = fixtures.product_events(spark, SMOKE_DIR)
    f = rollups.daily_product_funnel(ev)
    tot = f.agg(F.sum("n_prices").alias("n"), F.sum(F.col("view") + F.col("cart") + F.col("purchase")).alias("s")).first()
    with_cat = ev.where(F.split("category_code", "[.]")[0].isNotNull()).count()
    assert tot.n == with_cat
    assert tot.s <= tot.n


def test_scale_settings_bounds():
    from funnelworks.session import scale_settings

    small = scale_settings(10 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    big = scale_settings(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 372_530   # 100 TB in pieces of 256 MB
    mid = scale_settings(1 << 40, 800)
    assert int(mid["spark.sql.shuffle.partitions"]) == 4096


def test_sorted_funnel_nulls_first_and_category_filter(spark):
    ev = _events(spark, [
        (1, _t(2), "view", "c.b", "z", 1.0),
        (2, _t(1), "view", "c", "z", 1.0),
        (3, _t(1), "view", "c.a", None, 1.0),
        (4, _t(1), "view", "d.a", "y", 1.0),
    ])
    rows = [(r.category, r.event_day.day, r.classification, r.brand) for r in rollups.daily_product_funnel(ev, sort=True).collect()]
    assert rows == [("c", 1, None, "z"), ("c", 1, "a", None), ("c", 2, "b", "z"), ("d", 1, "a", "y")]
    assert [r.category for r in rollups.category_funnel(ev, "d").collect()] == ["d"]


def test_partitioned_write_and_append(spark, tmp_dir):
    from funnelworks.sources import sinks

    ev = _events(spark, [(i, _t(1 + i % 3), "view", f"c{i % 4}.k", "b", 1.0) for i in range(40)])
    funnel = rollups.daily_product_funnel(ev)
    path = sinks.write_partitioned(funnel, f"{tmp_dir}/rollup", "category", ["event_day", "classification", "brand"])
    import os

    assert sorted(d for d in os.listdir(path) if d.startswith("category=")) == [f"category=c{i}" for i in range(4)]
    back = sinks.read_back(spark, path, schema=funnel.schema)
    assert back.where(F.col("category") == "c1").count() == 3
    out = f"{tmp_dir}/append"
    sinks.append_rows(ev, out)
    sinks.append_rows(ev, out)
    assert spark.read.parquet(out).count() == 80   # append semantics, as the reference's inserts


def _lists(spark, rows, chunk_rows):
    """Lists by group (day, brand) from event rows."""
    found = {}
    got = rollups.price_lists(_events(spark, rows), chunk_rows=chunk_rows).collect()
    for r in got:
        assert 0 < len(r.prices) <= chunk_rows
        found.setdefault((r.event_day.day, r.brand), []).append(r.prices)
    assert len({(r.category, r.event_day, r.classification, r.brand, r.chunk) for r in got}) == len(got)
    return found


def _counted(prices):
    from collections import Counter

    return Counter(prices)


def test_price_lists_without_ids_and_with_one_price(spark):
    rows = [(None, _t(1), "view", "c.k", "b", 2.5)] * 1000 + [(None, _t(1), "view", "c.k", None, None)] * 35
    found = _lists(spark, rows, 10)
    assert sorted(map(len, found[1, "b"])) == [10] * 100
    assert sorted(map(len, found[1, None])) == [5, 10, 10, 10]
    assert {p for prices in found[1, "b"] for p in prices} == {2.5} and {p for prices in found[1, None] for p in prices} == {None}


def test_price_lists_of_small_groups_are_whole(spark):
    import random

    rng = random.Random(1)
    rows = [(None, _t(1 + i % 3), "view", "c.k", rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 40))])) for i in range(900)]
    found = _lists(spark, rows, 10_000)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(len(lists) for lists in found.values()) <= len(found) + tasks
    for (day, brand), lists in found.items():
        assert _counted(p for prices in lists for p in prices) == _counted(r[5] for r in rows if (r[1].day, r[4]) == (day, brand))


def test_price_lists_of_many_values_at_once(spark, monkeypatch):
    from funnelworks.operators import price_lists

    monkeypatch.setattr(price_lists, "VALUES_AT_ONCE", 50)
    rows = [(None, _t(1), "view", "c.k", "b", float(i % 37)) for i in range(1500)]
    found = _lists(spark, rows, 29)[1, "b"]
    assert _counted(p for prices in found for p in prices) == _counted(r[5] for r in rows)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(found) <= 1500 // 29 + 1 + tasks


def test_price_lists_read_the_events_once(spark, tmp_dir):
    rows = [(i, _t(1), "view", "c.k", "b", float(i % 7)) for i in range(100)]
    _events(spark, rows).write.parquet(f"{tmp_dir}/events")
    chunks = rollups.price_lists(spark.read.parquet(f"{tmp_dir}/events"), chunk_rows=4)
    chunks.collect()
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1, final
    assert "Join" not in final


def test_stored_footprint_counts_files_and_bytes(spark, tmp_dir):
    import os

    from funnelworks.sources import sinks

    out = f"{tmp_dir}/t"
    spark.range(1000).repartition(3).write.parquet(out)
    got = sinks.stored_footprint(spark, out).first()
    files = [f for f in os.listdir(out) if f.endswith(".parquet")]
    assert got.n_files == len(files) == 3
    assert got.n_bytes == sum(os.path.getsize(os.path.join(out, f)) for f in files)


def test_bounded_broadcast(spark):
    from funnelworks.operators.joins import MAX_BROADCAST_ROWS, bounded_broadcast

    small = spark.range(10)
    assert bounded_broadcast(small, MAX_BROADCAST_ROWS + 1) is small   # over the bound: no hint
    hinted = bounded_broadcast(small, 10)
    joined = spark.range(100).join(hinted, "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_declared_schemas_match_files(spark):
    from funnelworks.sources.tables import SCHEMAS, read_table, table_path
    from tests.conftest import SMOKE_DIR

    for name in SCHEMAS:
        assert read_table(spark, SMOKE_DIR, name).schema.simpleString() == \
            spark.read.parquet(table_path(SMOKE_DIR, name)).schema.simpleString()


def test_stored_category_values_come_back(spark, tmp_dir):
    from funnelworks.sources import sinks

    values = ["", "~", "~x", "__HIVE_DEFAULT_PARTITION__", "a b", None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "category string, n int")
    path = sinks.write_partitioned(df, f"{tmp_dir}/t", "category", ["n"])
    back = sinks.read_back(spark, path, schema=df.schema, partition_col="category")
    assert {r.n: r.category for r in back.collect()} == dict(enumerate(values))
    assert back.where("category = ''").first().n == 0


def test_sizing_follows_the_input(spark, tmp_dir):
    from funnelworks.session import fit_to_input, stored_bytes

    spark.range(1000).write.parquet(f"{tmp_dir}/t")
    assert stored_bytes(spark, f"{tmp_dir}/t") > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = fit_to_input(spark, f"{tmp_dir}/t")
    assert applied["spark.sql.files.maxPartitionBytes"] == "256m" == spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert "spark.sql.shuffle.partitions" not in applied         # given by the session's user
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for key in applied:
        spark.conf.unset(key)


def test_one_category_is_read_from_its_folder_alone(spark, tmp_dir):
    from funnelworks.operators.lookups import stored_category
    from funnelworks.sources import sinks

    codes = ["a.k", "", "~x.k", "a/b=c%d.k", None]
    funnel = rollups.daily_product_funnel(_events(spark, [(i, _t(1 + i % 3), "view", codes[i % 5], "b", 1.0) for i in range(60)]))
    path = sinks.write_partitioned(funnel, f"{tmp_dir}/rollup", "category", ["event_day"])
    for name in ("a", "", "~x", "a/b=c%d", "none"):
        got = stored_category(spark, path, name, funnel.schema)
        assert sorted(map(repr, got.select(*funnel.columns).collect())) == sorted(map(repr, funnel.where(F.col("category") == name).collect()))
        assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) == (name != "none")
