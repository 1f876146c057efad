"""Category discovery and the daily product funnel.

The reference scans the event collection once per top-level category and stores one
collection per category. Here it is one scan and one aggregation keyed by
``(category, event_day, classification, brand)``; storage is one table partitioned by
``category``.

Scale notes
* Every aggregate is algebraic (count_if / count / min / max / sum) so Spark does a
  map-side partial aggregation: a hot (category, day, brand) group is pre-combined in
  every task before the shuffle and never sits in one task as raw rows.
* The per-group price list of the reference (``$push``) is unbounded; ``price_lists`` builds
  lists of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.constants import FUNNEL_STAGES
from funnelworks.functions.paths import classification, to_day, top_category
from funnelworks.operators.price_lists import FUNNEL_KEYS, price_list_summary, price_lists

__all__ = [
    "FUNNEL_KEYS", "category_funnel", "daily_product_funnel", "event_categories", "funnel_rows", "price_list_summary",
    "price_lists", "price_summary", "stage_counts", "top_categories",
]


def event_categories(events: DataFrame) -> DataFrame:
    """Distinct full category codes (A1)."""
    return events.select("category_code").distinct()


def top_categories(events: DataFrame) -> DataFrame:
    """Distinct non-null top-level categories (A2 + P6)."""
    return (
        events.select(top_category("category_code").alias("category"))
        .where(F.col("category").isNotNull())
        .distinct()
    )


def funnel_rows(events: DataFrame) -> DataFrame:
    """Events projected onto the funnel keys; rows without a category are dropped."""
    return events.select(
        top_category("category_code").alias("category"),
        to_day("event_time").alias("event_day"),
        classification("category_code").alias("classification"),
        "brand",
        "event_type",
        "price",
    ).where(F.col("category").isNotNull())


def stage_counts() -> list[Column]:
    """``$sum: {$cond: [{$eq: [event_type, stage]}, 1, 0]}`` per stage (A4); 0 on no match."""
    return [F.count_if(F.col("event_type") == stage).alias(stage) for stage in FUNNEL_STAGES]


def price_summary() -> list[Column]:
    """Bounded summary of the pushed price list: its size, NULLs kept (D2), and range."""
    return [
        F.count(F.lit(1)).alias("n_prices"),
        F.count_if(F.col("price").isNull()).alias("n_null_prices"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("price").alias("sum_price"),
    ]


def daily_product_funnel(events: DataFrame, sort: bool = False) -> DataFrame:
    """Per (category, day, classification, brand): view/cart/purchase counts + price summary.

    ``sort=True`` adds the reference's ascending (day, classification, brand) order
    (NULLs first) inside each category; leave it off when the result is aggregated or
    written further.
    """
    out = funnel_rows(events).groupBy(*FUNNEL_KEYS).agg(*stage_counts(), *price_summary())
    if sort:
        out = out.orderBy("category", "event_day", "classification", "brand")
    return out


def category_funnel(events: DataFrame, category: str) -> DataFrame:
    """The funnel of one category (the reference's per-category pipeline, P7).

    The equality on the grouping key is pushed below the aggregation by Catalyst.
    """
    return daily_product_funnel(events).where(F.col("category") == F.lit(category))
