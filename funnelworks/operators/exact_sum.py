"""Sums of doubles without rounding on the way.

A double is a whole number of at most 53 bits times a power of two, so it is the sum of three
signed digits at neighbouring places of base 2**32. Digits of a place are whole numbers: their
sums are exact and do not depend on the order, the partitions or the number of tasks. A group
has one partial row for each place of its values' highest digits (a handful), which tasks
combine before the shuffle. At the end a group's places are put together in whole numbers and
rounded once, to the nearest double: the result of ``math.fsum``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_BITS = 32
DIGITS = 3
# Below this place the highest digit of a subnormal would need a power of two that is none.
LOWEST_PLACE = -31


def _shift(x: Column, places: Column) -> Column:
    """``x * 2**(BASE_BITS * places)``, exactly, in two steps as the power alone may be too large."""
    half = F.floor(places / 2)
    return x * F.pow(F.lit(2.0), half * BASE_BITS) * F.pow(F.lit(2.0), (places - half) * BASE_BITS)


def _with_digits(df: DataFrame, value: str) -> DataFrame:
    """``_place`` of the highest digit and the digits ``_d0, _d1, _d2`` of a finite or NULL value."""
    size = F.abs(value)
    place = F.when(size > 0, F.greatest(F.floor(F.log2(size) / BASE_BITS), F.lit(LOWEST_PLACE))).otherwise(0)
    out = df.withColumn("_place", place.cast("int")).withColumn("_rest", F.col(value))
    for i in range(DIGITS):
        # The whole part at a place is taken off; what is left is exact.
        scaled = _shift(F.col("_rest"), F.lit(i) - F.col("_place"))
        out = out.withColumn(f"_d{i}", F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("bigint"))
        if i < DIGITS - 1:
            out = out.withColumn("_rest", F.col("_rest") - _shift(F.col(f"_d{i}").cast("double"), F.col("_place") - i))
    return out.drop("_rest")


_SUMS = [f"_s{i}" for i in range(DIGITS)]
_ODD = ["_nan", "_up", "_down"]
# What ``exact_parts`` adds to the keys.
PART_SCHEMA = "_place int, " + ", ".join(f"{c} decimal(38,0)" for c in _SUMS) + ", " + ", ".join(f"{c} bigint" for c in _ODD) + ", _n bigint"


def exact_parts(df: DataFrame, keys: Sequence[Column], value: Column) -> DataFrame:
    """The exact sums of ``value`` by named ``keys``, as digits: a row for each place of a group.

    Parts of several tables can be put together (``merged_parts``) before ``exact_totals``
    rounds them; columns are the keys and ``PART_SCHEMA``.
    """
    odd = [F.isnan(value), value == float("inf"), value == float("-inf")]
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    rows = df.select(*keys)
    names = rows.columns
    rows = df.select(*keys, finite.cast("double").alias("_v"), *[F.coalesce(o, F.lit(False)).alias(c) for o, c in zip(odd, _ODD, strict=True)])
    return _with_digits(rows, "_v").groupBy(*names, "_place").agg(
        *[F.coalesce(F.sum(F.col(f"_d{i}").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(c) for i, c in enumerate(_SUMS)],
        *[F.count_if(F.col(c)).alias(c) for c in _ODD],
        F.count(F.lit(1)).alias("_n"),
    )


def merged_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the same groups and places added up."""
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS]
    return parts.groupBy(*keys, "_place").agg(*sums, *[F.sum(c).alias(c) for c in (*_ODD, "_n")])


def exact_totals(parts: DataFrame, keys: Sequence[str], out_col: str, count_col: str | None = None) -> DataFrame:
    """Each group's sum, rounded once, from its merged parts.

    Infinities and NaN give what floating-point addition gives. ``count_col`` adds the rows of
    the group.
    """
    # At most a struct for each of the places that doubles have (66).
    part = F.struct(F.col("_place").alias("place"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(_SUMS)])
    groups = parts.groupBy(*keys).agg(F.collect_list(part).alias("_parts"), *[F.sum(c).alias(c) for c in (*_ODD, "_n")])
    nan, up, down = (F.col(c) > 0 for c in _ODD)
    total = (
        F.when(nan | (up & down), F.lit(float("nan")))
        .when(up, F.lit(float("inf")))
        .when(down, F.lit(float("-inf")))
        .otherwise(_nearest("_parts"))
    )
    return groups.select(*keys, total.alias(out_col), *([F.col("_n").alias(count_col)] if count_col else []))


def exact_sum(df: DataFrame, keys: Sequence[Column], value: Column, out_col: str, count_col: str | None = None) -> DataFrame:
    """The sum of ``value`` by named ``keys``, rounded once; NULLs add nothing, a group of them sums to 0."""
    return exact_totals(exact_parts(df, keys, value), df.select(*keys).columns, out_col, count_col)


BASE = 1 << BASE_BITS
# Places above the highest that carries can reach.
CARRIES = 3


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _normal(digits: str) -> str:
    """Digits from the lowest place on as digits of 0 to BASE - 1, and the carry: 0, or -1 below zero."""
    start = "struct(CAST(0 AS DECIMAL(38,0)) AS c, CAST(array() AS ARRAY<DECIMAL(38,0)>) AS ds)"
    total = "CAST(a.c + d AS DECIMAL(38,0))"
    low = f"CAST(pmod(t, CAST({BASE} AS DECIMAL(38,0))) AS DECIMAL(38,0))"
    step = _let(total, "t", _let(low, "l", f"struct(CAST((t - l) / {BASE}BD AS DECIMAL(38,0)) AS c, concat(a.ds, array(l)) AS ds)"))
    return f"aggregate({digits}, {start}, (a, d) -> {step})"


def _nearest(parts: str) -> Column:
    """The double nearest to the sum of the parts' digits, ties to even."""
    zero = "CAST(0 AS DECIMAL(38,0))"
    lowest = f"array_min(transform({parts}, p -> p.place)) - {DIGITS - 1}"
    highest = f"array_max(transform({parts}, p -> p.place)) + {CARRIES}"
    own = " ".join(f"WHEN p.place - {i} = j THEN p.s{i}" for i in range(DIGITS))
    at_place = f"aggregate({parts}, {zero}, (a, p) -> CAST(a + CASE {own} ELSE {zero} END AS DECIMAL(38,0)))"
    dense = f"transform(sequence({lowest}, {highest}), j -> {at_place})"
    flipped = "transform(f, x -> CAST(-x AS DECIMAL(38,0)))"
    signed = _let(
        _normal("f"),
        "n",
        f"CASE WHEN n.c < 0 THEN struct(-1.0D AS sign, {_normal(flipped)}.ds AS ds) ELSE struct(1.0D AS sign, n.ds AS ds) END",
    )
    # The three highest digits, and one bit more that tells whether anything is below them: more
    # than twice the bits of a double, so one rounding gives the nearest.
    three = f"((get(s.ds, k) * {BASE}BD + coalesce(get(s.ds, k - 1), {zero})) * {BASE}BD + coalesce(get(s.ds, k - 2), {zero}))"
    below = "CASE WHEN exists(slice(s.ds, 1, greatest(k - 2, 0)), x -> x <> 0) THEN 1BD ELSE 0BD END"
    bits = f"CAST(CAST({three} * 2BD + {below} AS DECIMAL(38,0)) AS DOUBLE)"
    power = f"({BASE_BITS} * (k - 2 + {lowest}) - 1)"
    scaled = f"s.sign * {bits} * pow(2.0D, floor({power} / 2)) * pow(2.0D, {power} - floor({power} / 2))"
    top = "array_max(transform(s.ds, (x, i) -> CASE WHEN x <> 0 THEN i ELSE -1 END))"
    value = _let(signed, "s", _let(top, "k", f"CASE WHEN k < 0 THEN 0.0D ELSE {scaled} END"))
    return F.expr(_let(dense, "f", value))
