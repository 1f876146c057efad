"""Join helpers: broadcast only under a proven row bound.

A side is broadcast when the caller can state an upper bound on its rows that follows
from the request (days in a range, pivot rows), never from the data volume. Past the
bound the hint is withheld and Spark/AQE plans a shuffle join from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest proven row bound broadcast by hint.
MAX_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, row_bound: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if 0 <= row_bound <= limit else df
