"""Keyed message batches: rank within key, cut into batches of 20, encode as JSON.

The producer of the reference accumulates products per search term and sends a JSON
array every 20 items, plus a final partial batch. A term is a very hot key (13 terms
for the whole crawl), so ranking with ``row_number() OVER (PARTITION BY key)`` would
put a whole term in one task.

A key's rows are counted first (one number a key). A key of more than ``bucket_rows`` rows is
cut into buckets at bounds found in a sample of its rows, about ``OVERSAMPLE`` a bucket, taken
by a hash of the values; a bucket's rows are counted as well. Both are aggregates of two
columns, and what they give has at most a row for ``bucket_rows`` rows of the table. Then the
items move once, to the task of their (key, bucket), where their position plus the rows of the
earlier buckets is their rank in the key. A batch lies in one bucket, but for those that reach
over a bound: their two parts are put together at the end, and nothing else moves again.
Everything is decided by values, so a lost executor's tasks are recomputed to the same ranks
and no checkpoint is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.constants import BATCH_SIZE
from funnelworks.operators.joins import MAX_BROADCAST_ROWS

# Rows of a key that one task ranks, and sampled rows for each bucket of a larger key.
BUCKET_ROWS = 500_000
OVERSAMPLE = 32


def _position(bounds: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving; 0 without bounds."""
    halves = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]
    steps = F.array(*[F.lit(h) for h in halves])
    size = F.coalesce(F.size(bounds), F.lit(0))

    def step(at: Column, half: Column) -> Column:
        to = at + half
        return F.when((to <= size) & (F.get(bounds, to - F.lit(1)) <= value), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _place(order_col: str, columns: Sequence[str]) -> Column:
    """What orders the rows of a key: the order column, then a hash of the row for ties."""
    return F.struct(F.col(order_col).alias("o"), F.xxhash64(*columns).alias("h"))


def _bounds(df: DataFrame, key_col: str, place: Column, bucket_rows: int, large: DataFrame) -> DataFrame:
    """``_k, _bounds`` of the large keys: every ``OVERSAMPLE``-th of their sampled places."""
    share = max(bucket_rows // OVERSAMPLE, 1)
    rows = df.select(F.col(key_col).alias("_k"), place.alias("_p")).join(F.broadcast(large), F.col("_k").eqNullSafe(F.col("_large")), "left_semi")
    sampled = rows.where(F.pmod(F.xxhash64("_p"), F.lit(share)) == 0)
    places = sampled.groupBy("_k").agg(F.sort_array(F.collect_list("_p")).alias("_all"))
    every = F.filter("_all", lambda _, i: i % OVERSAMPLE == OVERSAMPLE - 1)
    return places.select("_k", F.array_distinct(every).alias("_bounds"))


def _bucketed(df: DataFrame, key_col: str, order_col: str, bucket_rows: int | None, partitions: int | None) -> tuple[DataFrame, bool]:
    """``df`` with ``_p`` (place), ``_bucket``, ``_before`` (rows of the key in earlier buckets) and
    ``_n`` (rows of the bucket; NULL in a key of one bucket), and whether any key has several."""
    place = _place(order_col, df.columns)
    sizes = df.groupBy(F.col(key_col).alias("_large")).agg(F.count(F.lit(1)).alias("_rows"))
    if bucket_rows is None:
        bucket_rows = BUCKET_ROWS if not partitions else max((sizes.agg(F.sum("_rows")).first()[0] or 0) // partitions, 1)
    # At most a key for ``bucket_rows`` rows of the table; more than a broadcast takes are split
    # into larger buckets.
    heavy = sizes.where(F.col("_rows") > bucket_rows).select("_large", "_rows")
    found = heavy.agg(F.count(F.lit(1)), F.sum("_rows"), F.max("_rows")).first()
    if not found[0]:
        whole = df.withColumns({"_p": place, "_bucket": F.lit(0), "_before": F.lit(0).cast("bigint"), "_n": F.lit(None).cast("bigint")})
        return whole, False
    bucket_rows = max(bucket_rows, OVERSAMPLE * found[1] // MAX_BROADCAST_ROWS)
    large = heavy.where(F.col("_rows") > bucket_rows).select("_large")
    bounds = _bounds(df, key_col, place, bucket_rows, large)
    most = 2 * found[2] // bucket_rows + OVERSAMPLE
    placed = df.withColumn("_p", place).join(F.broadcast(bounds), F.col(key_col).eqNullSafe(F.col("_k")), "left")
    placed = placed.withColumn("_bucket", _position(F.col("_bounds"), F.col("_p"), most)).drop("_k")
    in_order = Window.partitionBy("_bk").orderBy("_b")
    counts = placed.where(F.col("_bounds").isNotNull()).groupBy(F.col(key_col).alias("_bk"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
    on = F.col(key_col).eqNullSafe(F.col("_bk")) & (F.col("_bucket") == F.col("_b"))
    joined = placed.drop("_bounds").join(F.broadcast(before), on, "left").drop("_bk", "_b")
    return joined.withColumn("_before", F.coalesce("_before", F.lit(0))), True


def _ranked(df: DataFrame, key_col: str, order_col: str, bucket_rows: int | None, partitions: int | None) -> tuple[DataFrame, bool]:
    """``_bucketed`` rows in the task of their (key, bucket), with ``_rank`` from 1 in the key."""
    placed, several = _bucketed(df, key_col, order_col, bucket_rows, partitions)
    inside = Window.partitionBy(key_col, "_bucket").orderBy("_p")
    return placed.withColumn("_rank", F.col("_before") + F.row_number().over(inside)), several


def rank_within_key(
    df: DataFrame, key_col: str, order_col: str, rank_col: str = "rank", partitions: int | None = None, bucket_rows: int | None = None
) -> DataFrame:
    """1-based rank of each row inside its key by ``order_col`` (ties by a hash of the row).

    A key of more than ``bucket_rows`` rows is ranked by several tasks; ``partitions`` sets
    that number to the table's rows over so many tasks. Rows of a key that are equal in every
    column stay in one task.
    """
    ranked, _ = _ranked(df, key_col, order_col, bucket_rows, partitions)
    return ranked.select(*df.columns, F.col("_rank").alias(rank_col))


def batch_envelopes(
    items: DataFrame,
    key_col: str,
    order_col: str,
    item_cols: Sequence[str],
    batch_size: int = BATCH_SIZE,
    bucket_rows: int | None = None,
) -> DataFrame:
    """``key, batch_no, n_items, first_id, last_id, value`` — one message per batch.

    ``value`` is the JSON array of the batch's items in ``order_col`` order, NULL fields
    written as ``null`` (F13). Each group holds at most ``batch_size`` rows.
    """
    taken = items.select(key_col, order_col, *[c for c in item_cols if c != order_col])
    ranked, several = _ranked(taken, key_col, order_col, bucket_rows, None)
    number = F.expr(f"(_rank - 1) div {int(batch_size)}")
    start = number * batch_size
    # A batch that begins before its bucket, or ends after it and is not cut by the key's end.
    over = F.coalesce((start < F.col("_before")) | (start + batch_size > F.col("_before") + F.col("_n")), F.lit(False))
    item = F.struct(*[F.col(c) for c in item_cols])
    rows = ranked.select(
        F.col(key_col).alias("key"), "_bucket", number.alias("batch_no"), over.alias("_over"),
        F.col(order_col).alias("_id"), F.struct(F.col("_rank").alias("r"), item.alias("i")).alias("_item"),
    )
    # (key, bucket) already are together: lists of a batch's rows need no exchange.
    pieces = rows.groupBy("key", "_bucket", "batch_no").agg(
        F.collect_list("_item").alias("_items"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.first("_over").alias("_over")
    )
    if several:
        halves = pieces.where("_over").groupBy("key", "batch_no").agg(
            F.flatten(F.collect_list("_items")).alias("_items"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
        )
        pieces = pieces.where("NOT _over").drop("_bucket", "_over").unionByName(halves)
    value = F.to_json(F.transform(F.array_sort("_items"), lambda s: s["i"]), {"ignoreNullFields": "false"})
    return pieces.select("key", "batch_no", F.size("_items").cast("bigint").alias("n_items"), "first_id", "last_id", value.alias("value"))
