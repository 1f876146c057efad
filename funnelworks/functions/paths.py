"""Column helpers for dotted category paths, days and date ranges.

All helpers return Column expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.constants import CATEGORY_DELIMITER, DAY_FORMAT, LABEL_FORMAT


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_level(code: str | Column, level: int) -> Column:
    """Element ``level`` of the dotted path; NULL when the code is NULL or too short.

    ``split`` takes a regex, so the delimiter is quoted; ``get`` returns NULL out of
    range where ``code[i]`` would raise under ANSI mode.
    """
    parts = F.split(_col(code), "[" + CATEGORY_DELIMITER + "]")
    return F.get(parts, level)


def top_category(code: str | Column) -> Column:
    return path_level(code, 0)


def classification(code: str | Column) -> Column:
    return path_level(code, 1)


def to_day(ts: str | Column) -> Column:
    """Truncate a timestamp to its UTC day (replaces format-then-parse, F3+F4)."""
    return F.to_date(_col(ts))


def day_string(ts: str | Column) -> Column:
    return F.date_format(_col(ts), DAY_FORMAT)


def day_label(day: str | Column) -> Column:
    return F.date_format(_col(day), LABEL_FORMAT)


def parse_day(value: str | dt.date) -> dt.date:
    """Parse a request day ``yyyy-mm-dd``; raises ValueError on bad input."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


def parse_day_col(s: str | Column) -> Column:
    """Column form of the request-date parse (F5): NULL instead of an error on bad input."""
    return F.try_to_date(_col(s), "yyyy-MM-dd")


def ts_literal(day: dt.date, like: T.DataType) -> Column:
    """Midnight of ``day`` as a literal of the same timestamp flavour as the column.

    Matching the column type keeps the comparison a plain literal predicate that the
    parquet scan receives in ``PushedFilters`` (no cast on the column side).
    """
    target = "timestamp_ntz" if isinstance(like, T.TimestampNTZType) else "timestamp"
    return F.lit(day.isoformat() + " 00:00:00").cast(target)


def half_open_day_range(
    df: DataFrame, ts_col: str, from_day: str | dt.date, to_day_: str | dt.date
) -> Column:
    """``ts >= from 00:00 AND ts < (to + 1 day) 00:00`` written on the raw column."""
    start = parse_day(from_day)
    stop = parse_day(to_day_) + dt.timedelta(days=1)
    col_type = df.schema[ts_col].dataType
    if isinstance(col_type, T.DateType):  # a day column: compare days, no cast on the column
        return (F.col(ts_col) >= F.lit(start)) & (F.col(ts_col) < F.lit(stop))
    return (F.col(ts_col) >= ts_literal(start, col_type)) & (
        F.col(ts_col) < ts_literal(stop, col_type)
    )


def calendar(spark: SparkSession, from_day: str | dt.date, to_day_: str | dt.date) -> DataFrame:
    """Inclusive day spine ``[from, to]`` with its label; empty when from > to.

    The spine has exactly ``to - from + 1`` rows, known before any job runs.
    """
    start, stop = parse_day(from_day), parse_day(to_day_)
    n_days = max((stop - start).days + 1, 0)
    return spark.range(n_days).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("event_day")
    ).withColumn("label", day_label("event_day"))


def day_count(from_day: str | dt.date, to_day_: str | dt.date) -> int:
    return max((parse_day(to_day_) - parse_day(from_day)).days + 1, 0)
