"""The named queries and their SQL oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the Spark job over the whole input
tables; ``ORACLES[name]`` is the equivalent DuckDB SQL. Column names match between the
two. Queries whose feature is a write (partitioned rollup, idempotent day overwrite,
connector round trip, stream ingest) perform the write into the shared checkpoint
folder and return the read-back table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelworks import constants as C
from funnelworks.operators import envelopes, extract, incremental, listings, overview, rollups, sales
from funnelworks.functions.paths import day_string, parse_day_col
from funnelworks.plans import oracles as O
from funnelworks.session import shared_path
from funnelworks.sources import fixtures, sinks
from funnelworks.streaming import funnel as funnel_stream
from funnelworks.streaming import ingest

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# --------------------------------------------------------------------------- funnel

FUNNEL_COLUMNS = [
    "category", "event_day", "classification", "brand", "view", "cart", "purchase",
    "n_prices", "n_null_prices", "min_price", "max_price", "sum_price",
]

# Category used by the per-category statistics query.
STATISTIC_CATEGORY = "medium"


@register(
    "scan_product_events",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        body="SELECT event_id, event_time, event_type, category_code, brand, price FROM product_events",
    ),
)
def q_scan_product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.product_events(spark, sf_dir).select(
        "event_id", "event_time", "event_type", "category_code", "brand", "price"
    )


@register(
    "first_event",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        body="SELECT event_id, event_time, event_type, category_code, brand, price "
        "FROM product_events ORDER BY event_id LIMIT 1",
    ),
)
def q_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.operators.lookups import first_match

    return first_match(fixtures.raw_events(spark, sf_dir), "event_id", lambda rows: fixtures.of_products(spark, sf_dir, rows))


@register(
    "event_categories",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, body="SELECT DISTINCT category_code FROM product_events"),
)
def q_event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.event_categories(fixtures.product_events(spark, sf_dir))


@register(
    "top_categories",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        body="SELECT DISTINCT list_extract(string_split(category_code, '.'), 1) AS category "
        "FROM product_events WHERE list_extract(string_split(category_code, '.'), 1) IS NOT NULL",
    ),
)
def q_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.top_categories(fixtures.product_events(spark, sf_dir))


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel in oracle column order, the float sum rounded to cents (one projection)."""
    out = rollups.daily_product_funnel(fixtures.product_events(spark, sf_dir))
    return out.select(
        *[F.round(c, 2).alias(c) if c == "sum_price" else F.col(c) for c in FUNNEL_COLUMNS]
    )


@register(
    "daily_product_funnel",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE, O.FUNNEL_ROWS_CTE, O.FUNNEL_CTE, body="SELECT * FROM funnel"
    ),
)
def q_daily_product_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(spark, sf_dir)


@register(
    "price_lists",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        O.FUNNEL_ROWS_CTE,
        body="""SELECT category, event_day, classification, brand,
       CAST(count(*) AS BIGINT) AS n_prices,
       CAST(count_if(price IS NULL) AS BIGINT) AS n_null_prices,
       min(price) AS min_price, max(price) AS max_price
FROM funnel_rows GROUP BY category, event_day, classification, brand""",
    ),
)
def q_price_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = rollups.price_lists(fixtures.product_events(spark, sf_dir))
    return rollups.price_list_summary(chunks)


@register(
    "price_list_values",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        O.FUNNEL_ROWS_CTE,
        body="""SELECT category, event_day, classification, brand, price, CAST(count(*) AS BIGINT) AS n
FROM funnel_rows GROUP BY category, event_day, classification, brand, price""",
    ),
)
def q_price_list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lists hold: every price of every group, NULL included, and how often."""
    chunks = rollups.price_lists(fixtures.product_events(spark, sf_dir))
    values = chunks.select(*rollups.FUNNEL_KEYS, F.explode("prices").alias("price"))
    return values.groupBy(*rollups.FUNNEL_KEYS, "price").agg(F.count(F.lit(1)).alias("n"))


@register(
    "sorted_funnel",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE, O.FUNNEL_ROWS_CTE, O.FUNNEL_CTE,
        body="SELECT * EXCLUDE (sum_price), row_number() OVER (PARTITION BY category "
        "ORDER BY event_day NULLS FIRST, classification NULLS FIRST, brand NULLS FIRST) AS position FROM funnel",
    ),
)
def q_sorted_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted funnel, each row with its place in its category as the rows come."""
    ordered = rollups.daily_product_funnel(fixtures.product_events(spark, sf_dir), sort=True).drop("sum_price")
    return _numbered(ordered, "category")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with their ``position`` among those of a key, in the order in which they come."""
    seen = rows.withColumn("_at", F.monotonically_increasing_id())
    return seen.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_at")).cast("bigint")).drop("_at")


@register(
    "event_days",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        body="SELECT DISTINCT strftime(event_time, '%Y-%m-%d') AS text, CAST(event_time AS DATE) AS day FROM product_events",
    ),
)
def q_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = day_string("event_time").alias("text")
    days = fixtures.product_events(spark, sf_dir).select(text).distinct()
    return days.select("text", parse_day_col("text").alias("day"))


@register(
    "blank_category_rollup",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE.replace("product_events AS", "given_events AS", 1),
        """
product_events AS (
  SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 13 = 1 THEN '~x' ELSE category_code END AS category_code)
  FROM given_events)""",
        O.FUNNEL_ROWS_CTE,
        O.FUNNEL_CTE,
        body="SELECT category, CAST(sum(n_prices) AS BIGINT) AS n_events FROM funnel GROUP BY category",
    ),
)
def q_blank_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollup of events some of whose codes are empty, or start like the escape."""
    code = F.when(F.col("event_id") % 13 == 0, F.lit("")).when(F.col("event_id") % 13 == 1, F.lit("~x"))
    events = fixtures.product_events(spark, sf_dir).withColumn("category_code", code.otherwise(F.col("category_code")))
    stored = _store(spark, rollups.daily_product_funnel(events))
    return stored.groupBy("category").agg(F.sum("n_prices").alias("n_events"))


def _stored_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, _funnel(spark, sf_dir))


def _funnel_table(spark: SparkSession, funnel: DataFrame) -> tuple[str, StructType]:
    path = shared_path(spark, "daily_product_funnel")
    sinks.write_partitioned(funnel, path, "category", ["event_day", "classification", "brand"])
    return path, funnel.schema


def _store(spark: SparkSession, funnel: DataFrame) -> DataFrame:
    path, schema = _funnel_table(spark, funnel)
    return sinks.read_back(spark, path, schema=schema, partition_col="category")


@register(
    "category_statistics",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        O.FUNNEL_ROWS_CTE,
        O.FUNNEL_CTE,
        body=f"""SELECT event_day, classification, brand, view, cart, purchase, n_prices
FROM funnel WHERE category = '{STATISTIC_CATEGORY}'""",
    ),
)
def q_category_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.operators.lookups import stored_category

    path, schema = _funnel_table(spark, _funnel(spark, sf_dir))
    return stored_category(spark, path, STATISTIC_CATEGORY, schema).select(
        "event_day", "classification", "brand", "view", "cart", "purchase", "n_prices"
    )


@register(
    "partitioned_rollup",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        O.FUNNEL_ROWS_CTE,
        O.FUNNEL_CTE,
        body="""SELECT category, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(view) AS BIGINT) AS view, CAST(sum(cart) AS BIGINT) AS cart,
       CAST(sum(purchase) AS BIGINT) AS purchase
FROM funnel GROUP BY category""",
    ),
)
def q_partitioned_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_funnel(spark, sf_dir)
    return stored.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("view").alias("view"),
        F.sum("cart").alias("cart"),
        F.sum("purchase").alias("purchase"),
    )


SLICES = 3


@register(
    "incremental_funnel",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, O.FUNNEL_ROWS_CTE, O.FUNNEL_CTE, body="SELECT * FROM funnel"),
)
def q_incremental_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after all events were applied in three slices, one of them twice."""
    root = shared_path(spark, "incremental_funnel")
    events = fixtures.product_events(spark, sf_dir)
    for n in (0, 1, 1, 2):
        incremental.apply_slice(events.where(F.col("event_id") % SLICES == n), root, f"slice-{n}")
    rollup = incremental.read_rollup(spark, root)
    return rollup.select(*[F.round(c, 2).alias(c) if c == "sum_price" else F.col(c) for c in FUNNEL_COLUMNS])


# Event that closes the last day of an append stream: its own day stays open.
def _sentinel(spark: SparkSession, last: dt.datetime) -> DataFrame:
    after = last + dt.timedelta(days=30)
    row = [(after, "view", "sentinel", None, None)]
    return spark.createDataFrame(row, "event_time timestamp_ntz, event_type string, category_code string, brand string, price double")


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events in the order of their time, in two halves."""
    events = fixtures.product_events(spark, sf_dir)
    first, last = events.agg(F.min("event_time"), F.max("event_time")).first()
    if first is None:
        return [events]
    middle = F.lit((first + (last - first) / 2).isoformat(sep=" ")).cast("timestamp_ntz")
    late = F.col("event_time") >= middle
    return [events.where(~late), events.where(late), _sentinel(spark, last)]


@register(
    "stream_daily_funnel",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, O.FUNNEL_ROWS_CTE, O.FUNNEL_CTE, body="SELECT * FROM funnel"),
)
def q_stream_daily_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written as the watermark closes them; the query is restarted from its checkpoint
    after each arrival."""
    root = shared_path(spark, "stream_daily_funnel")
    for events in _arrivals(spark, sf_dir):
        funnel_stream.land_events(events, f"{root}/events")
        source = funnel_stream.event_files(spark, f"{root}/events")
        funnel_stream.append_days(source, f"{root}/days", f"{root}/checkpoint").awaitTermination()
    days = funnel_stream.read_days(spark, f"{root}/days")
    return days.select(*[F.round(c, 2).alias(c) if c == "sum_price" else F.col(c) for c in FUNNEL_COLUMNS])


@register(
    "stream_funnel_totals",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, O.FUNNEL_ROWS_CTE, O.FUNNEL_CTE, body="SELECT * FROM funnel"),
)
def q_stream_funnel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup published after every batch, the events of the second half arriving first."""
    root = shared_path(spark, "stream_funnel_totals")
    for events in reversed(_arrivals(spark, sf_dir)[:2]):
        funnel_stream.land_events(events, f"{root}/events")
        source = funnel_stream.event_files(spark, f"{root}/events")
        funnel_stream.publish_totals(source, f"{root}/totals", f"{root}/checkpoint").awaitTermination()
    totals = sinks.read_version(spark, f"{root}/totals", funnel_stream.FUNNEL_SCHEMA)
    return totals.select(*[F.round(c, 2).alias(c) if c == "sum_price" else F.col(c) for c in FUNNEL_COLUMNS])


# ------------------------------------------------------------------------- overview

# Request of the overview queries: a range with two empty days before the data, and an
# IN-list that leaves one category of the data out.
OVERVIEW_FROM, OVERVIEW_TO, OVERVIEW_TO_EXCL = "2023-12-30", "2024-01-20", "2024-01-21"
OVERVIEW_CATEGORIES = ["economy", "large", "medium", "promo", "small"]
_OV = O.overview_ctes(OVERVIEW_FROM, OVERVIEW_TO_EXCL, OVERVIEW_CATEGORIES)


def _ov_args(spark: SparkSession, sf_dir: str):
    return fixtures.product_events(spark, sf_dir), OVERVIEW_FROM, OVERVIEW_TO, OVERVIEW_CATEGORIES


@register(
    "overview_counts",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        _OV[0],
        body="SELECT category, event_day, CAST(count(*) AS BIGINT) AS count "
        "FROM overview_rows GROUP BY category, event_day",
    ),
)
def q_overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.overview_counts(*_ov_args(spark, sf_dir))


@register(
    "overview_pivot",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, *_OV, body="SELECT * FROM overview_pivot"),
)
def q_overview_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.overview_pivot(*_ov_args(spark, sf_dir))


_DENSE_COLS = ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in OVERVIEW_CATEGORIES)


@register(
    "overview_dense",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        *_OV,
        body=f"""SELECT c.event_day, strftime(c.event_day, '%d-%m-%Y') AS label, {_DENSE_COLS}
FROM (SELECT CAST(range AS DATE) AS event_day
      FROM range(DATE '{OVERVIEW_FROM}', DATE '{OVERVIEW_TO_EXCL}', INTERVAL 1 DAY)) c
LEFT JOIN overview_pivot p ON p.event_day = c.event_day""",
    ),
)
def q_overview_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, f, t, cats = _ov_args(spark, sf_dir)
    return overview.overview_dense(spark, events, f, t, cats)


_UNPIVOT = " UNION ALL ".join(
    f"SELECT event_day, '{c}' AS category, {c} AS count FROM overview_pivot"
    for c in OVERVIEW_CATEGORIES
)


@register(
    "overview_series",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        *_OV,
        body=f"""SELECT category, string_agg(CAST(count AS VARCHAR), ',' ORDER BY event_day) AS counts
FROM ({_UNPIVOT}) GROUP BY category""",
    ),
)
def q_overview_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = overview.overview_series(*_ov_args(spark, sf_dir))
    return series.select("category", F.array_join("counts", ",").alias("counts"))


@register(
    "category_overview",
    O.with_ctes(O.PRODUCT_EVENTS_CTE, *_OV, body="SELECT *, row_number() OVER (ORDER BY event_day) AS position FROM overview_pivot"),
)
def q_category_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview, at most a row a day of the request, with the place of each row as they come."""
    rows = overview.category_overview(spark, *_ov_args(spark, sf_dir))
    return _numbered(rows.withColumn("_all", F.lit(1)), "_all").drop("_all")


_EMPTY_RANGES = [("2023-12-01", "2023-12-31"), ("2024-01-01", "2024-01-05"), ("2024-01-20", "2024-01-10")]


@register(
    "empty_overviews",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        body=f"""SELECT f AS from_day, t AS to_day, NOT EXISTS (
           SELECT 1 FROM product_events WHERE event_time >= CAST(f AS TIMESTAMP) AND event_time < CAST(t AS TIMESTAMP) + INTERVAL 1 DAY
           AND list_extract(string_split(category_code, '.'), 1) IN ({", ".join(f"'{c}'" for c in OVERVIEW_CATEGORIES)})) AS is_empty
FROM (VALUES {", ".join(f"('{f}', '{t}')" for f, t in _EMPTY_RANGES)}) v(f, t)""",
    ),
)
def q_empty_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some requests find no event at all, as the endpoint asks first."""
    from funnelworks.operators.lookups import is_empty

    events = fixtures.product_events(spark, sf_dir)
    found = [(f, t, is_empty(overview.overview_rows(events, f, t, OVERVIEW_CATEGORIES))) for f, t in _EMPTY_RANGES]
    return spark.createDataFrame(found, "from_day string, to_day string, is_empty boolean")


@register(
    "overview_response",
    O.with_ctes(
        O.PRODUCT_EVENTS_CTE,
        *_OV,
        body=f"""SELECT category, string_agg(CAST(count AS VARCHAR), ',' ORDER BY event_day) AS counts,
       (SELECT string_agg(strftime(range, '%d-%m-%Y'), ',' ORDER BY range)
        FROM range(DATE '{OVERVIEW_FROM}', DATE '{OVERVIEW_TO_EXCL}', INTERVAL 1 DAY)) AS labels
FROM ({_UNPIVOT}) GROUP BY category""",
    ),
)
def q_overview_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = overview.overview_response(*_ov_args(spark, sf_dir))
    labels = F.array_join("labels", ",").alias("labels")
    return answer.select(F.explode("data").alias("category", "c"), labels).select(
        "category", F.array_join(F.col("c").cast("array<string>"), ",").alias("counts"), "labels"
    )


# ---------------------------------------------------------------------------- sales

SALES_FROM, SALES_TO, SALES_TO_EXCL = "1997-05-01", "1997-07-12", "1997-07-13"
SALES_POINT_DAY = "1997-07-12"

_SALES_RANGE = (
    f"l_shipdate >= TIMESTAMP '{SALES_FROM} 00:00:00' "
    f"AND l_shipdate < TIMESTAMP '{SALES_TO_EXCL} 00:00:00'"
)
_DAILY_SQL = (
    "SELECT CAST(l_shipdate AS DATE) AS day, round(coalesce(sum(l_extendedprice), 0), 2) AS sales "
    "FROM lineitem {where} GROUP BY CAST(l_shipdate AS DATE)"
)
# Prices times 2**48 are whole numbers, their sums are exact, and text is read to the nearest double.
_EXACT_SQL = (
    "SELECT CAST(l_shipdate AS DATE) AS day, "
    "CAST(CAST(sum(CAST(l_extendedprice * 281474976710656 AS HUGEINT)) AS VARCHAR) AS DOUBLE) / 281474976710656 AS sales "
    "FROM lineitem {where} GROUP BY CAST(l_shipdate AS DATE)"
)


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sales_listings(spark, sf_dir)


def _cents(df: DataFrame, *more: str) -> DataFrame:
    """Amounts rounded to cents, for comparison only: the operators do not round."""
    return df.withColumns({c: F.round(c, 2) for c in ("sales", *more)})


@register("daily_sales", _EXACT_SQL.format(where="WHERE " + _SALES_RANGE))
def q_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales.daily_sales(_listings(spark, sf_dir), SALES_FROM, SALES_TO)


@register("stream_daily_sales", _EXACT_SQL.format(where=""))
def q_stream_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales of listings that arrive in three files, one a batch, each in the table once."""
    root = shared_path(spark, "stream_daily_sales")
    listings_ = _listings(spark, sf_dir).select("timestamp", "price")
    listings_.repartition(3).write.parquet(f"{root}/arrivals")
    source = spark.readStream.schema(listings_.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arrivals")
    sales.stream_sales(source, f"{root}/sales", f"{root}/checkpoint").awaitTermination()
    sales.compact_sales(spark, f"{root}/sales")
    return sales.read_folded(spark, f"{root}/sales")


@register(
    "sales_total",
    "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS sales, CAST(count(*) AS BIGINT) AS n_rows "
    f"FROM lineitem WHERE {_SALES_RANGE} HAVING count(*) > 0",
)
def q_sales_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cents(sales.sales_total(_listings(spark, sf_dir), SALES_FROM, SALES_TO))


@register(
    "sales_points",
    f"SELECT * FROM ({_DAILY_SQL.format(where='WHERE ' + _SALES_RANGE)}) "
    f"WHERE day IN (DATE '{SALES_POINT_DAY}', DATE '{SALES_POINT_DAY}' - INTERVAL 1 DAY)",
)
def q_sales_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = sales.daily_sales(_listings(spark, sf_dir), SALES_FROM, SALES_TO)
    return _cents(sales.sales_points(daily, SALES_POINT_DAY))


@register(
    "sales_change",
    """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, coalesce(sum(l_extendedprice), 0) AS sales
           FROM lineitem GROUP BY CAST(l_shipdate AS DATE))
SELECT c.day, round(c.sales, 2) AS sales, round(p.sales, 2) AS prev_sales, round(c.sales - p.sales, 2) AS delta,
       CASE WHEN p.sales <> 0 THEN round((c.sales - p.sales) / p.sales * 100, 4) END AS pct
FROM d c JOIN d p ON c.day = CAST(p.day + INTERVAL 1 DAY AS DATE)""",
)
def q_sales_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = sales.sales_change(sales.daily_sales(_listings(spark, sf_dir)))
    return _cents(change, "prev_sales", "delta").withColumn("pct", F.round("pct", 4))


@register("daily_sales_idempotent", _DAILY_SQL.format(where="WHERE " + _SALES_RANGE))
def q_daily_sales_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "daily_sales")
    for _ in range(2):  # the second run must leave the table unchanged
        sales.store_daily_sales(
            sales.daily_sales(_listings(spark, sf_dir), SALES_FROM, SALES_TO), path
        )
    return _cents(sinks.read_back(spark, path, schema=sales.DAILY_SCHEMA).select("day", "sales"))


# ------------------------------------------------------------------------- listings

_FLAT_SQL = """SELECT l_orderkey AS response_id, CAST(l_partkey AS VARCHAR) AS asin,
       l_extendedprice AS price, l_linenumber AS line,
       CASE WHEN l_discount < 0.05 THEN 'organic' ELSE 'amazons_choices' END AS kind
FROM lineitem
WHERE l_orderkey % 11 NOT IN (0, 1) AND NOT (l_orderkey % 11 = 2 AND l_discount >= 0.05)"""

@register("stored_responses", f"SELECT asin, price, line, kind FROM ({_FLAT_SQL})")
def q_stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses stored as text files, read back and flattened."""
    from funnelworks.sources import connectors

    path = shared_path(spark, "responses")
    fixtures.search_responses(spark, sf_dir).select("body").write.text(path)
    return listings.flatten_listings(connectors.read_responses(spark, path)).drop("response_id")


@register(
    "flatten_full",
    """SELECT l_orderkey AS response_id, CAST(l_partkey AS VARCHAR) AS asin,
       CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END AS price, l_linenumber AS line, 'organic' AS kind,
       CAST(l_orderkey AS VARCHAR) AS seller, l_partkey % 3 = 0 AS unpriced
FROM lineitem WHERE l_partkey % 13 <> 0""",
)
def q_flatten_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = listings.flatten_listings(fixtures.mixed_responses(spark, sf_dir), document_col="listing")
    return flat.select(
        "response_id", "asin", "price", "line", "kind",
        F.get_json_object("listing", "$.seller.id").alias("seller"),
        (F.get_json_object("listing", "$.price") == "n/a").alias("unpriced"),
    )


@register(
    "flatten_found",
    """SELECT l_orderkey AS response_id, CAST(l_partkey AS VARCHAR) AS asin, l_linenumber AS line,
       CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END AS number, l_partkey % 3 = 0 AS is_text,
       CAST(l_orderkey AS VARCHAR) AS seller, 'organic' AS kind, 'asin string, line bigint, price string, seller string' AS fields
FROM lineitem WHERE l_partkey % 13 <> 0""",
)
def q_flatten_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the columns that their documents have, none of them declared."""
    responses = fixtures.mixed_responses(spark, sf_dir)
    fields = listings.found_fields(responses)
    flat = listings.flatten_found(responses, fields=fields)
    return flat.select(
        "response_id", "asin", "line", F.col("price").try_cast("double").alias("number"), (F.col("price") == "n/a").alias("is_text"),
        F.get_json_object("seller", "$.id").alias("seller"), "kind", F.lit(", ".join(f"{n} {k}" for n, k in fields.items())).alias("fields"),
    )


@register(
    "flatten_rejects",
    """SELECT l_orderkey AS response_id, 'malformed_json' AS reason, '{"content":' AS document
FROM lineitem WHERE l_partkey % 13 = 0
UNION ALL SELECT l_orderkey, 'element_not_an_object', '7' FROM lineitem WHERE l_partkey % 13 <> 0 AND l_partkey % 5 = 0""",
)
def q_flatten_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.flatten_rejects(fixtures.mixed_responses(spark, sf_dir))


# Deterministic stamping of the listings (FIXTURES §3.3).
STAMP_START = C.STAMP_START
STAMP_SPAN_SECONDS = 6_220_800
STAMP_WEIGHTS = {"response_id": 7919, "line": 104729}
# Random stamping window of the reference: 2024-05-01 up to the run time; fixed here.
RANDOM_END = dt.datetime.combine(C.ROLLUP_LAST_DAY, dt.time(23, 59, 59))
AMPLIFY_COPIES = 3


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.flatten_listings(fixtures.search_responses(spark, sf_dir))


@register("flatten_listings", _FLAT_SQL)
def q_flatten_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir)


@register(
    "stamped_listings",
    f"""SELECT *, TIMESTAMP '2024-05-01 00:00:00'
         + to_seconds((response_id * 7919 + line * 104729) % {STAMP_SPAN_SECONDS}) AS timestamp
FROM ({_FLAT_SQL})""",
)
def q_stamped_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.modular_stamp(_flat(spark, sf_dir), STAMP_WEIGHTS, STAMP_START, STAMP_SPAN_SECONDS)


_RANDOM_SPAN = int((RANDOM_END - STAMP_START).total_seconds())
RANDOM_SEED = 7
_RANDOM_SQL = f"""SELECT *, TIMESTAMP '2024-05-01 00:00:00' + to_seconds(CAST('0x' || substr(md5(
         concat_ws(chr(31), '{RANDOM_SEED}', '0', response_id, line, kind)), 1, 13) AS BIGINT) % {_RANDOM_SPAN + 1}) AS timestamp
FROM ({_FLAT_SQL})"""


def _randomly_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["response_id", "line", "kind"]
    return listings.random_stamp(_flat(spark, sf_dir), STAMP_START, RANDOM_END, RANDOM_SEED, key_cols=keys)


@register("random_stamped_listings", _RANDOM_SQL)
def q_random_stamped_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _randomly_stamped(spark, sf_dir)


@register(
    "random_stamp_days",
    f"""SELECT CAST(timestamp AS DATE) AS day, CAST(count(*) AS BIGINT) AS n,
       abs(count(*) - sum(count(*)) OVER () / {(RANDOM_END - STAMP_START).days + 1}.0) < 6 * sqrt(sum(count(*)) OVER () / {(RANDOM_END - STAMP_START).days + 1}.0) AS even
FROM ({_RANDOM_SQL}) GROUP BY 1""",
)
def q_random_stamp_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random times by day, each with whether it has its even share within six deviations."""
    days = (RANDOM_END - STAMP_START).days + 1
    counts = _randomly_stamped(spark, sf_dir).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # One row a day of the window.
    share = F.sum("n").over(Window.partitionBy(F.lit(1))) / days
    return counts.withColumn("_share", share).select("day", "n", (F.abs(F.col("n") - F.col("_share")) < 6 * F.sqrt("_share")).alias("even"))


@register(
    "amplified_listings",
    f"SELECT *, CAST(unnest(range({AMPLIFY_COPIES})) AS INTEGER) AS copy FROM ({_FLAT_SQL})",
)
def q_amplified_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "amplified_listings")
    sinks.append_rows(listings.amplify(_flat(spark, sf_dir), AMPLIFY_COPIES), path)
    return sinks.read_back(spark, path)


@register(
    "table_footprint",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(sum(coalesce(strlen(url), 0) + coalesce(strlen(html), 0)) + 8 * count(page_id) AS BIGINT) AS n_bytes FROM pages",
)
def q_table_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.sources.tables import read_table

    return listings.table_footprint(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


# ----------------------------------------------------------------------- extraction

_PAGE_KEYS = "p_partkey AS page_id"


@register(
    "extract_products",
    f"""SELECT {_PAGE_KEYS}, 'é ' || p_name AS title, p_brand AS brand,
       CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_retailprice + p_size * 10 >= 1000 THEN NULL
            ELSE round(p_retailprice + p_size * 10, 2) END AS price,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS discount,
       CAST((p_size % 5) + 0.5 AS DOUBLE) AS rating,
       CAST(p_partkey AS BIGINT) * 37 AS reviews,
       CASE WHEN p_partkey % 4 = 0 THEN 'Not Available' ELSE 'In Stock' END AS availability,
       'Type=' || p_type || ';Size=' || CAST(p_size AS VARCHAR) || ';Pack=ABC' AS detail
FROM part WHERE p_partkey % 9 <> 0""",
)
def q_extract_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = extract.extract_products(fixtures.product_pages(spark, sf_dir))
    return products.withColumn("detail", extract.detail_string("detail"))


@register(
    "rejected_pages",
    f"SELECT {_PAGE_KEYS}, 'é ' || p_name AS title, 'missing_brand' AS reason FROM part WHERE p_partkey % 9 = 0",
)
def q_rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rejected_pages(fixtures.product_pages(spark, sf_dir))


_ORIGIN = r"regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


@register(
    "extract_links",
    rf"""WITH l AS (
  SELECT page_id, url AS page_url,
         list_transform(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gs'),
                                           '<a\s[^>]*href="([^"]*)"', 1), lambda h: replace(h, '&amp;', '&')) AS links
  FROM pages),
x AS (
  SELECT page_id, page_url, unnest(generate_series(0, len(links) - 1)) AS position,
         unnest(links) AS link
  FROM l)
SELECT page_id, CAST(position AS INTEGER) AS position, link,
       CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
            WHEN starts_with(link, '//') THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || link
            WHEN starts_with(link, '/') THEN {_ORIGIN} || link
            ELSE {_ORIGIN} || '/' || link END AS url
FROM x""",
)
def q_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.sources.tables import read_table

    return extract.extract_links(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


_SEGMENT = r"/([^/?#]*)(?:[?#].*)?$"


@register(
    "numeric_probe",
    f"""WITH s AS (SELECT page_id, regexp_extract(url, '{_SEGMENT}', 1) AS segment FROM pages)
SELECT page_id, segment, TRY_CAST(segment AS DOUBLE) IS NOT NULL AS is_number FROM s
UNION ALL SELECT page_id, page_id || t, t = '_000' FROM s, (VALUES ('d'), ('f'), ('_000'), (',000'), ('x1p3')) v(t)""",
)
def q_numeric_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.functions.html import is_number
    from funnelworks.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    seg = F.regexp_extract("url", _SEGMENT, 1)
    # Spellings that a SQL cast and Python's float() take differently.
    tails = F.array(*[F.concat(F.col("page_id").cast("string"), F.lit(t)) for t in ("d", "f", "_000", ",000", "x1p3")])
    probes = pages.select("page_id", F.explode(F.concat(F.array(seg), tails)).alias("segment"))
    return probes.select("page_id", "segment", is_number("segment").alias("is_number"))


@register(
    "search_result_links",
    """WITH l AS (
  SELECT p_partkey AS page_id, 0 AS position, '/dp/' || p_partkey || '?a=1&b=2' AS link FROM part
  UNION ALL SELECT p_partkey, 1, '/alt/' || p_partkey FROM part)
SELECT page_id, CAST(position AS INTEGER) AS position, link, 'https://shop.example.com' || link AS url FROM l""",
)
def q_search_result_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.search_result_links(fixtures.result_pages(spark, sf_dir))


# ------------------------------------------------------------ envelopes and ingest

_ITEMS_SQL = """SELECT p_name AS key, p_partkey AS id, p_brand AS brand,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price
FROM part"""
ENVELOPE_ITEM_SCHEMA = "id bigint, brand string, price double"


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.batch_envelopes(
        fixtures.envelope_items(spark, sf_dir), "key", "id", ["id", "brand", "price"]
    )


@register(
    "batch_envelopes",
    f"""WITH items AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM ({_ITEMS_SQL}))
SELECT key, CAST(floor((rn - 1) / 20) AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS n_items,
       min(id) AS first_id, max(id) AS last_id,
       CAST(to_json(list({{'id': id, 'brand': brand, 'price': price}} ORDER BY id)) AS VARCHAR) AS value
FROM items GROUP BY key, floor((rn - 1) / 20)""",
)
def q_batch_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir)


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Write the message files (good batches + bad messages), stream them in, return the table."""
    root = shared_path(spark, "ingest")
    messages = _envelopes(spark, sf_dir).select("key", "value").unionByName(
        fixtures.bad_messages(spark, sf_dir)
    )
    # Two files and one file per trigger: the stream commits two micro-batches.
    messages.repartition(2).write.mode("overwrite").json(f"{root}/topic")
    ingest.run_ingest(
        ingest.envelope_file_source(spark, f"{root}/topic", max_files=1),
        f"{root}/ingested", f"{root}/checkpoint", ENVELOPE_ITEM_SCHEMA,
    )
    return f"{root}/ingested"


@register(
    "stream_ingest",
    f"SELECT replace(lower(key), ' ', '_') AS collection, id, brand, price FROM ({_ITEMS_SQL})",
)
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_items(spark, _ingested(spark, sf_dir), ENVELOPE_ITEM_SCHEMA).drop(ingest.DOCUMENT)


@register(
    "ingest_whole_items",
    """SELECT lower(replace(p_name, ' ', '_')) AS collection, p_partkey AS id, CAST(NULL AS DOUBLE) AS price, p_type AS kind,
       CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS tags FROM part
UNION ALL SELECT lower(replace(p_name, ' ', '_')), -p_partkey, 1.5, NULL, NULL, '["a",null]' FROM part""",
)
def q_ingest_whole_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed items keep the fields that no schema declares."""
    root = shared_path(spark, "ingest_whole_items")
    fixtures.rich_messages(spark, sf_dir).write.json(f"{root}/topic")
    source = ingest.envelope_file_source(spark, f"{root}/topic", max_files=100)
    ingest.run_ingest(source, f"{root}/ingested", f"{root}/checkpoint", ENVELOPE_ITEM_SCHEMA)
    items = ingest.read_items(spark, f"{root}/ingested", ENVELOPE_ITEM_SCHEMA)
    field = lambda path, name: F.get_json_object(ingest.DOCUMENT, path).alias(name)
    return items.select("collection", "id", "price", field("$.kind", "kind"), field("$.box.size", "size"), field("$.tags", "tags"))


_KIND = f"p_partkey % {fixtures.BAD_MESSAGE_KINDS}"


@register(
    "dead_letters",
    f"""SELECT CASE WHEN {_KIND} = 0 THEN NULL WHEN {_KIND} = 1 THEN '' ELSE p_name END AS key,
       CASE WHEN {_KIND} <= 1 THEN '[{{"id": ' || p_partkey || '}}]'
            WHEN {_KIND} = 2 THEN '{{"id": ' || p_partkey || ', "brand": "' || p_brand || '"}}'
            WHEN {_KIND} = 3 THEN '[{{"id": ' || p_partkey || ','
            WHEN {_KIND} = 4 THEN NULL
            ELSE '[' || p_partkey || ']' END AS value,
       CASE WHEN {_KIND} <= 1 THEN 'missing_key' WHEN {_KIND} = 2 THEN 'not_a_list'
            WHEN {_KIND} = 3 THEN 'malformed_json' WHEN {_KIND} = 4 THEN 'null_value'
            ELSE 'bad_items' END AS reason
FROM part""",
)
def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_dead_letters(spark, _ingested(spark, sf_dir), ENVELOPE_ITEM_SCHEMA)


@register(
    "ingest_rejects",
    """SELECT p_name AS key, CASE WHEN p_partkey % 4 = 0 THEN '[{"id":' || p_partkey || ',"price":"x"}]' ELSE 'null' END AS value,
       CASE WHEN p_partkey % 4 = 0 THEN 'bad_items' ELSE 'bad_item' END AS reason
FROM part WHERE p_partkey % 4 IN (0, 1)""",
)
def q_ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dead_letters(ingest.parse_envelopes(fixtures.typed_messages(spark, sf_dir), ENVELOPE_ITEM_SCHEMA))


# ----------------------------------------------------------------------- connectors

SEGMENTS = [{"segment": "BUILDING", "weight": 2}, {"segment": "MACHINERY", "weight": 3}]


@register(
    "literal_rows",
    """SELECT segment, CAST(sum(weight) AS BIGINT) AS weight
FROM customer JOIN (VALUES ('BUILDING', 2), ('MACHINERY', 3)) v(segment, weight) ON c_mktsegment = segment GROUP BY segment""",
)
def q_literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.sources import connectors
    from funnelworks.sources.tables import read_table

    given = connectors.frame_from_records(spark, SEGMENTS, "segment string, weight bigint")
    people = read_table(spark, sf_dir, "customer", ["c_mktsegment"])
    matched = people.join(given, F.col("c_mktsegment") == F.col("segment"))
    return matched.groupBy("segment").agg(F.sum("weight").alias("weight"))

# The person table of the connector demo is ``customer``; balance stands in for age.
ROUND_TRIP_MIN_BALANCE = 2000


@register(
    "connector_round_trip",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer "
    f"WHERE c_acctbal > {ROUND_TRIP_MIN_BALANCE}",
)
def q_connector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from funnelworks.sources import connectors
    from funnelworks.sources.tables import read_table

    path = shared_path(spark, "connector_round_trip")
    connectors.save(read_table(spark, sf_dir, "customer"), path, "parquet", "append")
    people = connectors.load(spark, path, "parquet")
    return people.where(F.col("c_acctbal") > ROUND_TRIP_MIN_BALANCE).select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
