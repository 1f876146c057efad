import datetime as dt
import glob

from pyspark.sql import functions as F

from funnelworks.functions.paths import calendar
from funnelworks.operators import overview, sales

EV = "event_id bigint, event_time timestamp_ntz, event_type string, category_code string, brand string, price double"


def _ev(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    return spark.createDataFrame([
        (1, t(1), "view", "a.x", "b", 1.0),
        (2, t(1, 23), "view", "a", "b", 1.0),
        (3, t(2), "view", "b.y", "b", 1.0),
        (4, t(3), "view", "c.z", "b", 1.0),     # category not in the list
        (5, t(4), "view", None, "b", 1.0),
        (6, t(5), "view", "a.x", "b", 1.0),     # outside the range end (to = 4th)
    ], EV)


def test_overview_pivot_and_dense(spark):
    ev = _ev(spark)
    piv = {r.event_day.day: (r.a, r.b) for r in overview.overview_pivot(ev, "2024-01-01", "2024-01-04", ["a", "b"]).collect()}
    assert piv == {1: (2, 0), 2: (0, 1)}
    dense = overview.overview_dense(spark, ev, "2023-12-31", "2024-01-04", ["a", "b"]).orderBy("event_day").collect()
    assert [r.label for r in dense] == ["31-12-2023", "01-01-2024", "02-01-2024", "03-01-2024", "04-01-2024"]
    assert [(r.a, r.b) for r in dense] == [(0, 0), (2, 0), (0, 1), (0, 0), (0, 0)]


def test_overview_series_aligned_to_pivot_days(spark):
    s = {r.category: r.counts for r in overview.overview_series(_ev(spark), "2024-01-01", "2024-01-04", ["a", "b"]).collect()}
    assert s == {"a": [2, 0], "b": [0, 1]}


def test_reversed_and_empty_ranges(spark):
    ev = _ev(spark)
    assert calendar(spark, "2024-01-05", "2024-01-01").count() == 0
    assert overview.overview_dense(spark, ev, "2024-01-05", "2024-01-01", ["a"]).count() == 0
    assert overview.overview_pivot(ev, "2025-01-01", "2025-01-02", ["a"]).count() == 0


def test_overview_pivot_total_equals_long_total(spark):
    from funnelworks.sources import fixtures
    from tests.conftest import SMOKE_DIR

    ev = fixtures.product_events(spark, SMOKE_DIR)
    cats = ["economy", "large", "medium", "promo", "small"]
    long_total = overview.overview_counts(ev, "2024-01-01", "2024-01-30", cats).agg(F.sum("count")).first()[0]
    piv = overview.overview_pivot(ev, "2024-01-01", "2024-01-30", cats)
    piv_total = piv.select(sum(F.col(c) for c in cats).alias("t")).agg(F.sum("t")).first()[0]
    assert long_total == piv_total > 0


LS = "response_id bigint, line int, timestamp timestamp_ntz, price double"


def _listings(spark):
    t = lambda d, h=0: dt.datetime(1997, 5, d, h)
    return spark.createDataFrame([
        (1, 1, t(1), 10.0), (1, 2, t(1, 5), None), (2, 1, t(2), 5.5),
        (3, 1, t(4), 1.0), (4, 1, t(5), 2.0),
    ], LS)


def test_daily_sales_and_total(spark):
    li = _listings(spark)
    d = {r.day.day: r.sales for r in sales.daily_sales(li, "1997-05-01", "1997-05-04").collect()}
    assert d == {1: 10.0, 2: 5.5, 4: 1.0}   # day 3 has no rows -> no row (D4)
    assert sales.sales_total(li, "1997-05-01", "1997-05-02").first().sales == 15.5
    assert sales.sales_total(li, "1998-01-01", "1998-01-02").count() == 0   # A8: no row


def test_sales_change_pairs_calendar_days(spark):
    daily = sales.daily_sales(_listings(spark))
    ch = {r.day.day: (r.prev_sales, r.delta) for r in sales.sales_change(daily).collect()}
    assert ch == {2: (10.0, -4.5), 5: (1.0, 1.0)}   # day 4 has no day 3 -> no row


def test_store_daily_sales_is_idempotent(spark, tmp_dir):
    daily = sales.daily_sales(_listings(spark), "1997-05-01", "1997-05-05")
    path = f"{tmp_dir}/daily"
    sales.store_daily_sales(daily, path)
    sales.store_daily_sales(daily, path)
    assert spark.read.parquet(path).count() == daily.count() == 4


def test_store_daily_sales_keeps_the_other_days_of_a_month(spark, tmp_dir):
    def store(rows):
        sales.store_daily_sales(spark.createDataFrame(rows, "day date, sales double"), path)
        return {(r.day.month, r.day.day): r.sales for r in spark.read.parquet(path).collect()}

    path = f"{tmp_dir}/daily"
    first = store([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0), (dt.date(2024, 2, 1), 3.0)])
    kept = set(glob.glob(f"{path}/month=2024-02/*.parquet"))
    assert store([(dt.date(2024, 1, 2), 5.0), (dt.date(2024, 1, 3), None)]) == {**first, (1, 2): 5.0, (1, 3): None}
    assert set(glob.glob(f"{path}/month=2024-02/*.parquet")) == kept and len(kept) == 1


def test_category_overview_is_day_ordered(spark):
    out = overview.category_overview(spark, _ev(spark), "2023-12-31", "2024-01-04", ["a", "b"], dense=True).collect()
    days = [r.event_day for r in out]
    assert days == sorted(days) and len(days) == 5


def test_request_day_parsing(spark):
    import pytest

    from funnelworks.functions.paths import parse_day, parse_day_col

    assert parse_day("2024-07-12") == dt.date(2024, 7, 12)
    with pytest.raises(ValueError):
        parse_day("12-07-2024")
    got = spark.createDataFrame([("2024-07-12",), ("bad",), (None,)], "s string").select(parse_day_col("s").alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2024, 7, 12), None, None]


def test_lookups_and_literal_rows(spark):
    from funnelworks.operators.lookups import first_row, is_empty
    from funnelworks.sources.connectors import frame_from_records

    people = frame_from_records(spark, [{"name": "a", "age": 25, "city": "x"}, {"name": "b", "age": 19, "city": "y"}], "name string, age bigint, city string")
    assert first_row(people, "age").first().name == "b"
    assert not is_empty(people) and is_empty(people.where(F.col("age") > 99))


def test_api_sale_change_for_one_day(spark):
    from funnelworks import api

    daily = sales.daily_sales(_listings(spark))
    rows = api.sales_change(daily, "1997-05-02").collect()
    assert [(r.day.day, r.sales, r.prev_sales, r.delta) for r in rows] == [(2, 5.5, 10.0, -4.5)]
    alone = api.sales_change(daily, "1997-05-04").first()        # no sales the day before
    assert (alone.sales, alone.prev_sales, alone.delta, alone.pct) == (1.0, None, None, None)
    assert api.sales_change(daily, "1997-06-04").count() == 0


def test_sales_are_exact_and_ignore_text(spark):
    t = dt.datetime(1997, 5, 1)
    li = spark.createDataFrame([(t, 0.001), (t, 0.001)], "timestamp timestamp_ntz, price double")
    assert sales.daily_sales(li).first().sales == 0.002
    text = spark.createDataFrame([(t, "12.5")], "timestamp timestamp_ntz, price string")
    assert sales.daily_sales(text).first().sales == 0.0
    assert sales.daily_sales(text, parse_text=True).first().sales == 12.5


def test_api_first_event(spark):
    from funnelworks import api

    assert api.first_event(_ev(spark)).first().event_id == 1


def test_as_json_keeps_nulls(spark):
    import json

    from funnelworks import api

    row = api.as_json(api.first_event(_ev(spark))).first().json
    doc = json.loads(row)
    assert doc["event_id"] == 1 and doc["category_code"] == "a.x" and "price" in doc
    nulls = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(api.as_json(nulls).first().json) == {"a": 1, "b": None}


def test_range_on_date_and_ltz_columns_pushes_down(spark, tmp_dir):
    from funnelworks.functions.paths import half_open_day_range

    path = f"{tmp_dir}/days"
    spark.createDataFrame(
        [(dt.date(2024, 1, d), dt.datetime(2024, 1, d, 12)) for d in range(1, 11)], "d date, t timestamp"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    for col in ("d", "t"):
        q = df.where(half_open_day_range(df, col, "2024-01-03", "2024-01-05"))
        assert q.count() == 3
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(" + col in plan and "LessThan(" + col in plan
