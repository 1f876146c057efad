"""Search responses → flat listing rows, timestamp stamping and amplification
(S13, P11, F26, U1, F12, F30, U2, S14).

Per response the reference checks the shape (``content.results`` must be an object),
reads the two result arrays and inserts every element with a random timestamp. Here
the body is parsed once into a VARIANT, the shape test and both array reads use the
parsed value, and every element keeps its whole document beside its typed columns.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.constants import AMPLIFY_TARGET_BYTES, LISTING_FIELDS, RESULT_ARRAYS

# Why a response or an element gave no listing.
REJECT_REASONS = ("malformed_json", "results_not_an_object", "element_not_an_object")


def results_is_object(body: str | Column) -> Column:
    """``"content" in r and "results" in r["content"] and isinstance(results, dict)``.

    False for list-shaped ``results``; NULL (treated as false) when absent or malformed.
    """
    return _results_object(F.try_parse_json(F.col(body) if isinstance(body, str) else body))


def _is_object(v: Column, path: str = "$") -> Column:
    """Whether the value at ``path`` is an object: one reads as a struct without fields, whose
    reading looks at nothing inside (``schema_of_variant`` names every type in the value)."""
    return F.try_variant_get(v, path, "struct<>").isNotNull()


def _results_object(v: Column) -> Column:
    return _is_object(v, "$.content.results")


def _elements(responses: DataFrame, body_col: str, id_col: str) -> DataFrame:
    """One row per result element, and one without element for a response that has no result
    object: ``id_col, _body, _reason, _element, kind``.

    The parsed value and the result object are columns of their own that later steps read
    several times, so the optimiser keeps them apart and a body is parsed once. What is no array
    reads as NULL. The outer explode keeps it from adding a size filter, which would parse the
    body again below; an element's place tells which array it is from.
    """
    parsed = responses.select(
        F.col(id_col), F.col(body_col).alias("_body"), F.try_parse_json(F.col(body_col)).alias("_doc")
    )
    arrays = ",".join(f"{name}:array<variant>" for name in RESULT_ARRAYS)
    found = parsed.select(
        id_col, "_body", F.col("_doc").isNull().alias("_malformed"),
        F.try_variant_get("_doc", "$.content.results", f"struct<{arrays}>").alias("_results"),
    )
    lists = [F.coalesce(F.col(f"_results.{name}"), F.array().cast("array<variant>")) for name in RESULT_ARRAYS]
    reason = F.when(F.col("_malformed"), F.lit(REJECT_REASONS[0])).when(F.col("_results").isNull(), F.lit(REJECT_REASONS[1]))
    shaped = found.select(
        id_col, "_body", reason.alias("_reason"), F.size(lists[0]).alias("_first"),
        F.when(F.col("_results").isNotNull(), F.concat(*lists)).alias("_items"),
    )
    placed = shaped.select(id_col, "_body", "_reason", "_first", F.posexplode_outer("_items").alias("_place", "_element"))
    first, second = RESULT_ARRAYS
    kind = F.when(F.col("_place") < F.col("_first"), F.lit(first)).when(F.col("_place").isNotNull(), F.lit(second))
    return placed.select(id_col, "_body", "_reason", "_element", kind.alias("kind"))


def flatten_listings(
    responses: DataFrame,
    body_col: str = "body",
    id_col: str = "response_id",
    fields: str = LISTING_FIELDS,
    document_col: str | None = None,
) -> DataFrame:
    """One row per listing: ``id_col``, the typed ``fields``, and ``kind``.

    A missing result array counts as empty (D11); responses whose ``results`` is not an
    object and elements that are no objects yield no rows (see ``flatten_rejects``).
    ``fields`` is DDL; a field that is absent or does not convert is NULL. With
    ``document_col``, that column holds the whole listing as JSON, every field as received.
    """
    element = F.col("_element")
    typed = [
        F.try_variant_get(element, f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in T.StructType.fromDDL(fields).fields
    ]
    whole = [F.to_json(element).alias(document_col)] if document_col else []
    return _elements(responses, body_col, id_col).where(_is_object(element)).select(id_col, *typed, "kind", *whole)


# Fields that ``found_fields`` makes columns of; a response of more has data for names.
MAX_FIELDS = 1000

# Types as they are found to the types of columns; all others are text (JSON for nested values).
COLUMN_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "DECIMAL": "double", "BOOLEAN": "boolean"}


def found_fields(responses: DataFrame, body_col: str = "body", id_col: str = "response_id", max_fields: int = MAX_FIELDS) -> dict[str, str]:
    """The fields that the listings have and the type each fits, found in the documents.

    One aggregation over all listings: the types of a field's values are merged where they are
    read, so a row a field and task is shuffled. Numbers of several kinds become doubles, fields
    with values of different kinds text; nested values are kept as JSON text.
    """
    element = F.col("_element")
    objects = _elements(responses, body_col, id_col).where(_is_object(element)).select(element.alias("_element"))
    pairs = objects.lateralJoin(responses.sparkSession.tvf.variant_explode(F.col("_element").outer())).select("key", "value")
    found = pairs.groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind")).orderBy("key").limit(max_fields + 1).collect()
    if len(found) > max_fields:
        raise ValueError(f"listings have more than {max_fields} fields")
    return {r.key: COLUMN_TYPES.get(r.kind.split("(")[0], "string") for r in found}


def flatten_found(
    responses: DataFrame, body_col: str = "body", id_col: str = "response_id", fields: dict[str, str] | None = None
) -> DataFrame:
    """One row per listing with a typed column for every field found in the listings.

    The first pass finds the fields (unless given), the second reads them. A field named like
    ``id_col`` or ``kind`` gets a leading underscore.
    """
    fields = found_fields(responses, body_col, id_col) if fields is None else fields
    element = F.col("_element")

    def value(name: str, kind: str) -> Column:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return F.try_variant_get(element, f"$['{quoted}']", kind)

    def column(at: int, name: str, kind: str) -> Column:
        got = F.col(f"_value{at}")
        if kind == "string":  # a text itself, anything else as JSON, which has infinite numbers in quotes
            infinite = got.isin("Infinity", "-Infinity") & (F.schema_of_variant(value(name, "variant")) == "DOUBLE")
            got = F.when(infinite, F.concat(F.lit('"'), got, F.lit('"'))).otherwise(got)
        return got.alias(f"_{name}" if name in (id_col, "kind") else name)

    rows = _elements(responses, body_col, id_col).where(_is_object(element))
    # The values are columns of their own, so that each is read once.
    read = rows.select(id_col, "kind", "_element", *[value(n, k).alias(f"_value{i}") for i, (n, k) in enumerate(fields.items())])
    return read.select(id_col, *[column(i, n, k) for i, (n, k) in enumerate(fields.items())], "kind")


def flatten_rejects(
    responses: DataFrame, body_col: str = "body", id_col: str = "response_id"
) -> DataFrame:
    """What flattening leaves out: ``id_col, reason, document`` (the body, or the element).

    Bodies that are no JSON (repeated keys included), bodies without a result object, and
    result elements that are no objects.
    """
    element = F.col("_element")
    rows = _elements(responses, body_col, id_col).select(
        id_col, "_body", "_reason", "_element", "kind", _is_object(element).alias("_good")
    )
    return rows.where(F.col("_reason").isNotNull() | (F.col("kind").isNotNull() & ~F.col("_good"))).select(
        id_col,
        F.coalesce("_reason", F.lit(REJECT_REASONS[2])).alias("reason"),
        F.when(F.col("_reason").isNotNull(), F.col("_body")).otherwise(F.to_json(element)).alias("document"),
    )


def _ntz_plus_seconds(start: dt.datetime, seconds: Column) -> Column:
    """Wall-clock ``start + seconds`` as TIMESTAMP_NTZ, independent of the session zone."""
    base = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", seconds, base)


def modular_stamp(
    df: DataFrame,
    weights: dict[str, int],
    start: dt.datetime,
    span_seconds: int,
    out_col: str = "timestamp",
) -> DataFrame:
    """Deterministic stand-in for a random timestamp (F12): ``start + (Σ wᵢ·colᵢ) mod span``.

    Re-running a task gives the same value, which a random draw would not.
    """
    offset = None
    for c, w in weights.items():
        term = F.col(c).cast("bigint") * F.lit(w)
        offset = term if offset is None else offset + term
    return df.withColumn(out_col, _ntz_plus_seconds(start, F.pmod(offset, F.lit(span_seconds))))


def draw(keys: list[Column], seed: int, counter: int = 0) -> Column:
    """A number of 52 random bits from a row's identity (counter-based: no state, no order).

    The same row, seed and counter give the same number in any task and partitioning; another
    counter gives an independent draw of the row.
    """
    text = F.concat_ws("\x1f", F.lit(str(seed)), F.lit(str(counter)), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("bigint")


def random_stamp(
    df: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    seed: int = 42,
    out_col: str = "timestamp",
    key_cols: list[str] | None = None,
) -> DataFrame:
    """Uniform whole-second timestamp in ``[start, end]`` (F12 + F30), as the reference's
    ``random_date``. Drawn from the row's ``key_cols`` (all columns that a text has, unless
    given), so a row has the same time however the table is partitioned or recomputed."""
    span = int((end - start).total_seconds())
    keys = [F.col(k) for k in key_cols] if key_cols else _hashable(df)
    offset = F.pmod(draw(keys, seed), F.lit(span + 1))
    return df.withColumn(out_col, _ntz_plus_seconds(start, offset))


# Bytes of a value of the fixed-width types; the widths of the numbers as stored.
FIXED_WIDTHS = {
    T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _value_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    width = FIXED_WIDTHS.get(type(field.dataType))
    if width is not None:
        size = F.when(c.isNotNull(), F.lit(width))
    elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    else:  # decimals, nested values: their JSON text
        size = F.when(c.isNotNull(), F.octet_length(F.to_json(F.struct(c.alias("v")))))
    return F.coalesce(size, F.lit(0)).cast("bigint")


def table_footprint(df: DataFrame) -> DataFrame:
    """Row count and bytes of the values of all columns (S14; the collection size probe)."""
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def copies_for_target(footprint_bytes: int, target_bytes: int = AMPLIFY_TARGET_BYTES) -> int:
    """Copies needed so the amplified table reaches ``target_bytes`` (the 2 GB loop); 0 for
    an empty table, which no copying makes larger."""
    if footprint_bytes <= 0:
        return 0
    return max(1, math.ceil(target_bytes / footprint_bytes))


# Copies of one row that one task makes at a stretch.
COPY_BLOCK = 1000


def amplify(df: DataFrame, copies: int, copy_col: str = "copy") -> DataFrame:
    """Repeat every row ``copies`` times (U2), tagged 0..copies-1.

    Up to ``COPY_BLOCK`` copies expand in place: no join, no shuffle. Beyond that a row
    becomes one row per block of copies first, and the blocks are dealt out over the tasks,
    so a few rows with many copies are not written by a few tasks.
    """
    if copies <= 0:
        return df.withColumn(copy_col, F.lit(None).cast("int")).where(F.lit(False))
    if copies <= COPY_BLOCK:
        return df.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    starts = F.explode(F.sequence(F.lit(0), F.lit(copies - 1), F.lit(COPY_BLOCK)))
    # A fixed number of tasks: the blocks are small, what they expand to is not.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.withColumn("_from", starts).repartition(tasks, "_from", *_hashable(df))
    last = F.least(F.col("_from") + F.lit(COPY_BLOCK - 1), F.lit(copies - 1))
    return blocks.withColumn(copy_col, F.explode(F.sequence(F.col("_from"), last))).drop("_from")


def _hashable(df: DataFrame) -> list[Column]:
    """Columns that a hash takes (maps and variants do not)."""
    return [
        F.col(f"`{f.name}`") for f in df.schema.fields
        if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))
    ]
