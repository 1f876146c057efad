"""Point reads used by the service endpoints.

The reference answers these with ``find_one`` / a collection chosen by a request
parameter. Here they are bounded DataFrame reads: a top-1 (one row kept per task,
then merged) and a partition-pruned scan of the stored rollup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelworks.operators.joins import bounded_broadcast
from funnelworks.sources import sinks


def first_row(df: DataFrame, order_col: str) -> DataFrame:
    """The first document (S5 + O3). Ordered on ``order_col`` so the answer is stable.

    ``orderBy().limit(1)`` plans as TakeOrderedAndProject: each task keeps its own
    top row and only those cross to the final merge.
    """
    return df.orderBy(F.col(order_col).asc_nulls_last()).limit(1)


# Candidates whose join is tried first; each further range has ``GROWTH`` times as many.
FIRST_CANDIDATES = 256
GROWTH = 16


def first_match(
    candidates: DataFrame, order_col: str, match: Callable[[DataFrame], DataFrame], block: int = FIRST_CANDIDATES
) -> DataFrame:
    """``first_row(match(candidates), order_col)`` for a ``match`` that joins and filters rows one by one.

    The candidates' join is tried in ranges of ``order_col``, from its smallest values on and
    each range larger than all before it, until a row is found. A range is cut by the column
    alone and then read through a range predicate, so only its rows meet the join; rows that tie
    at a cut are in one range, and NULLs come last. A range's rows are few by construction, so
    they are the side that is broadcast up to a bound.
    """
    order = F.col(order_col)
    before = None
    while True:
        ahead = candidates.where(order.isNotNull() if before is None else order > F.lit(before))
        cut = ahead.select(order).orderBy(order).limit(block).agg(F.max(order), F.count(F.lit(1))).first()
        if cut[1] < block:  # the last range, with those that have no value
            rest = candidates if before is None else candidates.where(order.isNull() | (order > F.lit(before)))
            return first_row(match(rest), order_col)
        rows = ahead.where(order <= F.lit(cut[0]))
        found = first_row(match(bounded_broadcast(rows, block)), order_col)
        if not found.isEmpty():
            return found
        before, block = cut[0], block * GROWTH


def is_empty(df: DataFrame) -> bool:
    """Empty check at the API edge (P14); reads at most one row."""
    return df.isEmpty()


def category_statistics(stored_rollup: DataFrame, category: str) -> DataFrame:
    """Rows of one category from a rollup."""
    return stored_rollup.where(F.col("category") == F.lit(category))


def stored_category(spark: SparkSession, path: str, category: str, schema: StructType | str) -> DataFrame:
    """Rows of one category of the rollup stored by category at ``path`` (S6): its folder alone
    is listed and read, as the original opens one collection."""
    return sinks.read_partition(spark, path, "category", category, schema)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON object, NULL fields written as ``null`` (F13: the endpoints'
    JSON responses). Dates and timestamps are ISO strings."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))
