"""Daily sales rollup and day-over-day change.

The reference runs one aggregation per calendar day in a driver loop and inserts each
result. Here it is one grouped aggregation over the whole range (partial sums per task,
one shuffle of at most one row per day per task), stored with dynamic partition
overwrite so a re-run replaces days instead of duplicating them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from funnelworks.functions.paths import half_open_day_range, parse_day, to_day
from funnelworks.operators.exact_sum import PART_SCHEMA, exact_parts, exact_sum, exact_totals, merged_parts
from funnelworks.session import drop_folder, list_folder, path_exists
from funnelworks.sources import sinks

DAILY_SCHEMA = "day date, sales double, month string"
FOLDED_SCHEMA = f"day date, {PART_SCHEMA}"


def _numeric_price(df: DataFrame, price_col: str, parse_text: bool) -> Column:
    """``$sum`` ignores non-numbers (D3), text that reads as a number included, unless asked."""
    if isinstance(df.schema[price_col].dataType, T.NumericType):
        return F.col(price_col).cast("double")
    return F.col(price_col).try_cast("double") if parse_text else F.lit(None).cast("double")


def daily_sales(
    listings: DataFrame,
    from_day: str | dt.date | None = None,
    to_day_: str | dt.date | None = None,
    ts_col: str = "timestamp",
    price_col: str = "price",
    parse_text: bool = False,
) -> DataFrame:
    """``day, sales``: sum of prices per UTC day; days without rows emit nothing.

    With a range, only ``[from, to + 1 day)`` is read (predicate on the raw timestamp,
    pushed to the scan). Sales are the exact sum of the prices, rounded to a double once, so they
    do not depend on how the listings are spread over tasks. ``parse_text`` also sums prices that are text.
    """
    df = listings
    if from_day is not None and to_day_ is not None:
        df = df.where(half_open_day_range(df, ts_col, from_day, to_day_))
    return exact_sum(df, [to_day(ts_col).alias("day")], _numeric_price(df, price_col, parse_text), "sales")


def sales_total(
    listings: DataFrame,
    from_day: str | dt.date,
    to_day_: str | dt.date,
    ts_col: str = "timestamp",
    price_col: str = "price",
    parse_text: bool = False,
) -> DataFrame:
    """One row with the range total, or no row when the range is empty.

    Grouping by a constant gives no row for no input, as ``$group {_id: None}``.
    """
    df = listings.where(half_open_day_range(listings, ts_col, from_day, to_day_))
    # One group: a task sends a partial row for each place of its prices, and none if it has none.
    return exact_sum(df, [F.lit(0).alias("all")], _numeric_price(df, price_col, parse_text), "sales", "n_rows").select("sales", "n_rows")


def sales_points(daily: DataFrame, day: str | dt.date) -> DataFrame:
    """The stored rows of ``day`` and the day before (P13: the sale-change endpoint's reads)."""
    d = parse_day(day)
    return daily.where(F.col("day").isin(d, d - dt.timedelta(days=1)))


def sales_change(daily: DataFrame, day: str | dt.date | None = None) -> DataFrame:
    """Each day with the previous calendar day's sales: ``day, sales, prev_sales, delta, pct``.

    Pairs calendar days (a day whose previous day has no sales gets no row), unlike
    ``lag`` which would pair with the previous row. Each daily row is emitted twice —
    as itself and as the "previous" of the next day — and one aggregation by day puts
    the pair together: the daily table is computed once and no self-join is planned.
    With ``day``, only that day's row (the sale-change endpoint); the day filter is
    applied to the daily table before pairing, so only two days are paired. That row is
    there if either day has sales, with NULL for the day that has none. Nothing is rounded.
    """
    if day is not None:
        daily = sales_points(daily, day)
    no_value = F.lit(None).cast("double")
    both = F.explode(
        F.array(
            F.struct(F.col("day").alias("day"), F.col("sales").alias("cur"), no_value.alias("prev")),
            F.struct(F.date_add("day", 1).alias("day"), no_value.alias("cur"), F.col("sales").alias("prev")),
        )
    )
    paired = (
        daily.select(both.alias("p"))
        .select("p.*")
        .groupBy("day")
        .agg(F.max("cur").alias("sales"), F.max("prev").alias("prev_sales"))
    )
    if day is None:
        paired = paired.where(F.col("sales").isNotNull() & F.col("prev_sales").isNotNull())
    else:
        paired = paired.where(F.col("day") == F.lit(parse_day(day)))
    delta = F.col("sales") - F.col("prev_sales")
    return paired.select(
        "day",
        "sales",
        "prev_sales",
        delta.alias("delta"),
        F.when(F.col("prev_sales") != 0, delta / F.col("prev_sales") * 100).alias("pct"),
    )


def store_daily_sales(daily: DataFrame, path: str) -> str:
    """Merge the daily rows into the stored table; re-runs replace the same days.

    The table is partitioned by month, one file of at most 31 rows each. Only months with a
    new day are written again; the days they hold already stay unless ``daily`` has them.
    """
    month = F.date_format("day", "yyyy-MM").alias("month")
    merged = daily.select("day", "sales", month, F.lit(1).alias("_new"))
    if path_exists(daily.sparkSession, path):
        stored = daily.sparkSession.read.schema(DAILY_SCHEMA).parquet(path)
        merged = merged.unionByName(stored.select("day", "sales", month, F.lit(0).alias("_new")))
    days = merged.groupBy("month", "day").agg(F.max_by("sales", "_new").alias("sales"), F.max("_new").alias("_new"))
    touched = days.withColumn("_new", F.max("_new").over(Window.partitionBy("month"))).where("_new = 1").drop("_new")
    return sinks.overwrite_partitions(touched, path, "month")


def fold_batch(listings: DataFrame, root: str, batch_id: int) -> None:
    """Store the daily sales of one batch of a stream (for ``foreachBatch``).

    A batch has a folder of its own, written over, never added to: a batch that is replayed
    after a stop between its write and its commit leaves the same table. Batches that
    ``compact_sales`` has folded in are known by their number and left alone.
    """
    if batch_id > _folded(listings.sparkSession, root):
        parts = exact_parts(listings, [to_day("timestamp").alias("day")], _numeric_price(listings, "price", False))
        parts.write.mode("overwrite").parquet(f"{root}/batches/batch={batch_id}")


def _folded(spark: SparkSession, root: str) -> int:
    """The last batch that the base table holds; -1 without one."""
    version = sinks.current_version(spark, f"{root}/base")
    return int(version.removeprefix("upto-")) if version else -1


def _folded_parts(spark: SparkSession, root: str) -> DataFrame:
    """The sums of all batches before rounding: the base table and the batches after it."""
    parts = []
    folded = _folded(spark, root)
    if folded >= 0:
        parts.append(sinks.read_version(spark, f"{root}/base", FOLDED_SCHEMA))
    if path_exists(spark, f"{root}/batches"):
        batches = spark.read.schema(f"{FOLDED_SCHEMA}, batch bigint").parquet(f"{root}/batches")
        parts.append(batches.where(F.col("batch") > folded).drop("batch"))
    if not parts:
        return spark.createDataFrame([], FOLDED_SCHEMA)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return merged_parts(rows, ["day"])


def read_folded(spark: SparkSession, root: str) -> DataFrame:
    """Daily sales of all batches, ``day, sales``, equal bit by bit to those of all listings at once."""
    return exact_totals(_folded_parts(spark, root), ["day"], "sales")


def compact_sales(spark: SparkSession, root: str) -> None:
    """Fold the batches so far into the base table and delete their folders."""
    names = [n for n in list_folder(spark, f"{root}/batches") if n.startswith("batch=")]
    last = max((int(n.removeprefix("batch=")) for n in names), default=-1)
    if last <= _folded(spark, root):
        return
    sinks.publish_version(_folded_parts(spark, root), f"{root}/base", f"upto-{last}")
    for name in names:
        drop_folder(spark, f"{root}/batches/{name}")


def stream_sales(listings: DataFrame, root: str, checkpoint_path: str, available_now: bool = True) -> StreamingQuery:
    """Keep the daily sales of a stream of listings under ``root`` (S12 as a stream)."""
    writer = listings.writeStream.foreachBatch(lambda batch, batch_id: fold_batch(batch, root, batch_id))
    writer = writer.option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
