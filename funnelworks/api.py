"""User-facing entry points, one per data endpoint or script of the original service.

Each takes and returns DataFrames; nothing is collected. The service layer (HTTP,
auth, caching) is not part of this package.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from funnelworks.constants import ROLLUP_FIRST_DAY, ROLLUP_LAST_DAY
from funnelworks.operators import envelopes, extract, listings, lookups, overview, rollups, sales
from funnelworks.streaming import ingest

__all__ = [
    "as_json", "first_event", "category_statistics", "sales_change", "category_overview", "overview_response",
    "top_categories", "daily_product_funnel", "price_lists", "daily_sales",
    "flatten_listings", "flatten_rejects", "stamp_timestamps", "amplify", "extract_products",
    "rejected_pages", "extract_links", "search_result_links", "batch_envelopes", "ingest_stream",
]


def first_event(events: DataFrame, order_col: str = "event_id") -> DataFrame:
    """``GET /``: the first event (one row; empty when there are none)."""
    return lookups.first_row(events, order_col)


def category_statistics(stored_rollup: DataFrame, category: str) -> DataFrame:
    """``GET /get-statistic``: the stored funnel rows of one category (partition-pruned)."""
    return lookups.category_statistics(stored_rollup, category)


def sales_change(daily: DataFrame, day: str | dt.date) -> DataFrame:
    """``GET /get-sale-change``: sales of ``day``, of the day before, delta and percent."""
    return sales.sales_change(daily, day)


def category_overview(
    spark: SparkSession,
    events: DataFrame,
    from_day: str | dt.date,
    to_day: str | dt.date,
    categories: Sequence[str] = overview.DEFAULT_CATEGORIES,
    dense: bool = False,
) -> DataFrame:
    """``GET /get-overview?from=&to=``: counts per day and category (``dense`` adds all days)."""
    return overview.category_overview(spark, events, from_day, to_day, categories, dense)


as_json = lookups.as_json
overview_response = overview.overview_response
top_categories = rollups.top_categories
daily_product_funnel = rollups.daily_product_funnel
price_lists = rollups.price_lists


def daily_sales(
    listings_df: DataFrame,
    from_day: str | dt.date = ROLLUP_FIRST_DAY,
    to_day: str | dt.date = ROLLUP_LAST_DAY,
    ts_col: str = "timestamp",
    price_col: str = "price",
) -> DataFrame:
    """The daily sales rollup over the original window (the stamped listings' range)."""
    return sales.daily_sales(listings_df, from_day, to_day, ts_col, price_col)


flatten_listings = listings.flatten_listings
flatten_rejects = listings.flatten_rejects
amplify = listings.amplify
extract_products = extract.extract_products
rejected_pages = extract.rejected_pages
extract_links = extract.extract_links
search_result_links = extract.search_result_links
batch_envelopes = envelopes.batch_envelopes
ingest_stream = ingest.ingest_stream


def stamp_timestamps(
    df: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    seed: int | None = None,
    weights: dict[str, int] | None = None,
    out_col: str = "timestamp",
) -> DataFrame:
    """A timestamp in ``[start, end]`` per row: random (seeded) or, with ``weights``, a
    deterministic modular spread of the weighted key columns."""
    if weights:
        span = int((end - start).total_seconds()) + 1
        return listings.modular_stamp(df, weights, start, span, out_col)
    return listings.random_stamp(df, start, end, 42 if seed is None else seed, out_col)
