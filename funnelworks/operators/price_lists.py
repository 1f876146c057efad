"""The price lists of the funnel groups, in lists of bounded length.

The original pushes every price of a group onto one list. Here a group's prices are one or more
lists of at most ``chunk_rows`` values. No row needs an id and no group's size is looked up:

1. Equal rows are counted where they are read and added up, ``(group, price, n)``. However
   often a group repeats a price, it is one row from here on, and a row is told from all others
   by its values, which is what splits a hot group below.
2. What a price alone fills, ``n div chunk_rows`` lists of one price, is dealt out by a hash of
   (group, price, number) and made there.
3. The rest, fewer than ``chunk_rows`` of each price, is range-partitioned and sorted by
   (group, price). Spark's bounds cut a hot group anywhere between two prices. A task walks
   through its range and numbers the values of a group; every ``chunk_rows`` of them are a
   list. A group that fits into one task has one short list at most, others one for each task
   that they touch.

Recomputing a task gives the same lists, as both shuffles are keyed by values alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.paths import classification, to_day, top_category
from funnelworks.operators.partitioning import shuffle_partitions

FUNNEL_KEYS = ["category", "event_day", "classification", "brand"]
CHUNK_ROWS = 10_000

# Values that a task spreads out at a time.
VALUES_AT_ONCE = 1 << 20

# Lists of one price alone are numbered from here, those of a range by its task below.
FULL_LISTS = 1 << 62


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Runs of rows that stand for about ``VALUES_AT_ONCE`` values."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + VALUES_AT_ONCE, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


def _changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Whether a row's group differs from the one before (NULLs are equal); True for the first."""
    out = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        differ = np.zeros(batch.num_rows - 1, bool)
        for column in batch.columns[:n_keys]:
            a, b = column[1:], column[:-1]
            same = pc.fill_null(pc.equal(a, b), False)
            both = pc.and_(pc.is_null(a), pc.is_null(b))
            differ |= ~np.asarray(pc.or_(same, both))
        out[1:] = differ
    return out


def _fill(n_keys: int, chunk_rows: int, schema: pa.Schema):
    """Lists of at most ``chunk_rows`` values from rows (group, price, n) sorted by group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        owner: pa.RecordBatch | None = None  # group of the list under way, and its values
        held: list[pa.Array] = []
        held_n = 0

        def lists(keys: pa.RecordBatch, values: pa.Array, ends: list[int]) -> pa.RecordBatch:
            nonlocal number
            chunks = pa.array(range(number, number + len(ends)), pa.int64())
            number += len(ends)
            prices = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)
            return pa.RecordBatch.from_arrays([*keys.columns, chunks, prices], schema=schema)

        for batch in batches:
            counts = np.asarray(batch.column(n_keys + 1))
            for part in _slices(counts):
                rows = batch.slice(part.start, part.stop - part.start)
                first = _changes(rows, n_keys)
                key = rows.slice(0, 1).select(range(n_keys))
                if owner is not None and key.equals(owner):
                    first[0] = False
                elif owner is not None and held_n:
                    yield lists(owner, pa.concat_arrays(held), [held_n])
                    held, held_n = [], 0
                n = counts[part]
                group = np.cumsum(first)
                starts = np.cumsum(n) - n
                # Position of every value inside its group, the list under way included.
                begun = np.zeros(group[-1] + 1, np.int64)
                begun[group[first]] = starts[first]
                if not first[0]:
                    begun[0] = -held_n
                flat = pc.take(rows.column(n_keys), pa.array(np.repeat(np.arange(len(n)), n)))
                of_value = np.repeat(group, n)
                chunk = (np.arange(len(of_value)) - begun[of_value]) // chunk_rows
                cut = np.flatnonzero((np.diff(of_value) != 0) | (np.diff(chunk) != 0)) + 1
                owners = np.repeat(np.arange(len(n)), n)[np.concatenate([[0], cut])]
                # The list under way is put in front; the last one stays open.
                values = pa.concat_arrays([*held, flat])
                ends = [int(c) + held_n for c in cut]
                if ends:
                    keys = rows.select(range(n_keys)).take(pa.array(owners[:-1]))
                    yield lists(keys, values.slice(0, ends[-1]), ends)
                held = [values.slice(ends[-1] if ends else 0)]
                held_n = len(held[0])
                owner = rows.select(range(n_keys)).take(pa.array(owners[-1:]))
                if held_n == chunk_rows:
                    yield lists(owner, held[0], [held_n])
                    held, held_n = [], 0
        if owner is not None and held_n:
            yield lists(owner, pa.concat_arrays(held), [held_n])

    return run


def price_lists(events: DataFrame, chunk_rows: int = CHUNK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """The pushed price lists of the funnel groups, NULLs kept, at most ``chunk_rows`` values each.

    Output: the funnel keys, ``chunk`` (tells the lists of a group apart, in no given order),
    ``prices`` ARRAY<DOUBLE>. The concatenation of a group's lists is the original's list, whose
    order is undefined too.
    """
    keys = keys or FUNNEL_KEYS
    rows = events.select(
        top_category("category_code").alias("category"),
        to_day("event_time").alias("event_day"),
        classification("category_code").alias("classification"),
        "brand",
        F.col("price").cast("double").alias("price"),
    ).where(F.col("category").isNotNull())
    counted = rows.groupBy(*keys, "price").agg(F.count(F.lit(1)).alias("n"))
    types = dict(counted.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "chunk bigint", "prices array<double>"])

    tasks = shuffle_partitions(events.sparkSession)
    full = counted.where(F.col("n") >= chunk_rows).select(
        *keys, "price", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / chunk_rows))).alias("_i")
    )
    full = full.repartition(tasks, *keys, "price", "_i").select(
        *keys,
        # A price's lists have a hash of the price and their number, so that a group's differ.
        (F.pmod(F.xxhash64("price", "_i"), F.lit(FULL_LISTS)) + F.lit(FULL_LISTS)).alias("chunk"),
        F.array_repeat("price", F.lit(chunk_rows)).alias("prices"),
    )
    rest = counted.withColumn("n", F.col("n") % chunk_rows).where("n > 0").repartitionByRange(*keys, "price")
    arrow = _arrow_schema(counted, keys)
    filled = rest.sortWithinPartitions(*keys, "price").mapInArrow(_fill(len(keys), chunk_rows, arrow), schema)
    return full.unionByName(filled)


def _arrow_schema(df: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(df.select(*keys).schema)
    return pa.schema([*own, pa.field("chunk", pa.int64()), pa.field("prices", pa.list_(pa.float64()))])


def price_list_summary(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-group size / NULL count / min / max rebuilt from the lists."""
    keys = keys or FUNNEL_KEYS
    return chunks.groupBy(*keys).agg(
        F.sum(F.size("prices")).alias("n_prices"),
        F.sum(F.size(F.filter("prices", lambda x: x.isNull()))).alias("n_null_prices"),
        F.min(F.array_min("prices")).alias("min_price"),
        F.max(F.array_max("prices")).alias("max_price"),
    )
