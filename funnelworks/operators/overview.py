"""Category-by-day overview over a date range.

The reference pulls every matching event into the web process and pivots in pandas.
Here the range predicate is written on the raw timestamp so it reaches the parquet scan,
the IN-list runs on executors, and only the pivot (one row per day) is ever small
enough to reach the driver.

Bounded sizes: the pivot has at most ``day_count(from, to)`` rows and the per-category
series hold at most that many values, both fixed by the request before any job runs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.functions.paths import (
    calendar,
    day_count,
    day_label,
    half_open_day_range,
    parse_day,
    to_day,
    top_category,
)
from funnelworks.constants import DEFAULT_CATEGORIES
from funnelworks.operators.joins import bounded_broadcast


def overview_rows(
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """(category, event_day) of events in ``[from, to + 1 day)`` with a category in the list."""
    in_range = events.where(
        F.col("category_code").isNotNull()
        & half_open_day_range(events, "event_time", from_day, to_day_)
    )
    return in_range.select(
        top_category("category_code").alias("category"),
        to_day("event_time").alias("event_day"),
    ).where(F.col("category").isin(list(categories)))


def overview_counts(
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """Rows per (category, day)."""
    return (
        overview_rows(events, from_day, to_day_, categories)
        .groupBy("category", "event_day")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def overview_pivot(
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """One row per day with data, one integer column per category, 0 where absent.

    Written as one conditional count per category (what ``pivot(values)`` means), so
    the plan is a single partial + final aggregation with one exchange keyed by day;
    ``groupBy().pivot()`` would aggregate twice.
    """
    cats = list(categories)
    rows = overview_rows(events, from_day, to_day_, cats)
    return rows.groupBy("event_day").agg(
        *[F.count_if(F.col("category") == F.lit(c)).alias(c) for c in cats]
    )


def overview_dense(
    spark: SparkSession,
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """Every day of ``[from, to]`` with its ``dd-MM-yyyy`` label and zero-filled counts.

    Aligns the reference's ``labels`` (all days) with its ``data`` (days with rows).
    The pivot side has at most ``day_count`` rows, so it is broadcast under that bound.
    """
    cats = list(categories)
    pivot = overview_pivot(events, from_day, to_day_, cats)
    spine = calendar(spark, from_day, to_day_)
    joined = spine.join(
        bounded_broadcast(pivot, day_count(from_day, to_day_)), "event_day", "left"
    )
    return joined.select(
        "event_day",
        "label",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cats],
    )


def overview_series(
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """Column-oriented output: per category, its counts ordered by day (A10).

    Days are those of the pivot index, as in the reference (``to_dict(orient='list')``).
    Each list holds at most ``day_count(from, to)`` values.
    """
    cats = list(categories)
    long = overview_pivot(events, from_day, to_day_, cats).unpivot(
        "event_day", cats, "category", "count"
    )
    return long.groupBy("category").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_day", "count"))),
            lambda s: s["count"],
        ).alias("counts")
    )


def category_overview(
    spark: SparkSession,
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
    dense: bool = False,
) -> DataFrame:
    """The ``/get-overview`` endpoint (A12): faithful pivot, or the calendar-aligned one.

    Ordered by day (O2); the result has at most one row per requested day, so the final
    sort is over a bounded table.
    """
    if dense:
        out = overview_dense(spark, events, from_day, to_day_, categories)
    else:
        out = overview_pivot(events, from_day, to_day_, categories)
    return out.orderBy("event_day")


def overview_response(
    events: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
) -> DataFrame:
    """The endpoint's answer as one row (A10, A12): ``data``, the counts of every category by
    day with data, and ``labels``, every day of the range.

    Both are bounded by the request: one value per day, and per category and day. A reversed
    range has no labels.
    """
    cats = list(categories)
    first, last = parse_day(from_day), parse_day(to_day_)
    days = F.array_sort(F.collect_list(F.struct("event_day", *cats)))
    rows = overview_pivot(events, from_day, to_day_, cats).agg(days.alias("_days"))
    # A field of an array of structs is the array of that field.
    pairs = [x for c in cats for x in (F.lit(c), F.col("_days").getField(c))]
    if first <= last:
        labels = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: day_label(d))
    else:
        labels = F.array().cast("array<string>")
    return rows.select(F.create_map(*pairs).alias("data"), labels.alias("labels"))
