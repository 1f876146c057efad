"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**bits`` cells, the cells are numbered along a Hilbert
curve, and the rows in curve order are cut into shards whose row counts differ by at most
one. Rows close in all dimensions share a shard, so a reader that filters on any of the
dimensions skips whole files by their min/max statistics. DataFrame functions only.

Defined cases: NULL values of a dimension take cell 0; a NULL text has size 1 and the CRC
of no bytes (0); repeated rows keep one slot each; an empty table gives no rows; extra
columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import BROADCAST_ROWS, broadcast_if_small, cut, global_rank

SHARDS = 16
BITS = 8


def _rotate(value: int, by: int, n: int) -> int:
    by %= n
    return ((value << by) | (value >> (n - by))) & ((1 << n) - 1)


def curve_steps(n: int) -> tuple[list[int], int]:
    """One refinement step of the curve in ``n`` dimensions for every (state, cell).

    A state is the entry corner and direction of a sub-cube. Entry ``state << n | cell`` holds
    the cell's position along the curve and the state inside it, packed as
    ``position << state_bits | next_state``. Returns the table and ``state_bits``.
    """
    corners = 1 << n
    state_bits = (n * corners - 1).bit_length()

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    position_of = {i ^ (i >> 1): i for i in range(corners)}
    steps = []
    for state in range(n * corners):
        direction, entry = divmod(state, corners)
        for cell in range(corners):
            at = position_of[_rotate(cell ^ entry, -(direction + 1), n)]
            start = 0 if at == 0 else (k := 2 * ((at - 1) // 2)) ^ (k >> 1)
            turn = 0 if at == 0 else trailing_ones(at if at % 2 else at - 1) % n
            inner = ((direction + turn + 1) % n) * corners + (entry ^ _rotate(start, direction + 1, n))
            steps.append(at << state_bits | inner)
    return steps, state_bits


def curve_index(cells: list[Column], bits: int) -> Column:
    """Position along the Hilbert curve of a point given by its cell in each dimension."""
    n = len(cells)
    steps, state_bits = curve_steps(n)
    if n * bits + state_bits > 62:
        raise ValueError("dimensions times bits must leave room for the curve state in a long")
    table = F.array(*[F.lit(s) for s in steps])

    def corner(level: int) -> Column:
        return reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(F.shiftright(c, level).bitwiseAND(F.lit(1)), j) for j, c in enumerate(cells)],
        ).cast("int")

    def refine(acc: Column, cell: Column) -> Column:
        state = acc.bitwiseAND(F.lit((1 << state_bits) - 1)).cast("int")
        step = F.element_at(table, F.shiftleft(state, n).bitwiseOR(cell) + 1)
        return F.shiftleft(F.shiftright(acc, state_bits), n + state_bits).bitwiseOR(step.cast("long"))

    walked = F.aggregate(F.array(*[corner(i) for i in reversed(range(bits))]), F.lit(0).cast("long"), refine)
    return F.shiftright(walked, state_bits)


def value_codes(df: DataFrame, column: str, cells: int) -> DataFrame:
    """Cell of each distinct value of a column: its rank, spread evenly over the cells.

    One row per distinct value. Ranked in one task only when a count shows the values to be
    few; otherwise by range partitions.
    """
    values = cut(df.select(column).distinct())
    if values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        in_order = Window.orderBy(F.col(column).asc_nulls_first())
        ranked = values.select(column, (F.row_number().over(in_order) - 1).alias("_at"), F.lit(values.count()).alias("_of"))
    else:
        ranked = global_rank(values, [F.col(column).asc_nulls_first()], "_at", "_of")
    code = F.expr(f"least(_at * {cells} div _of, {cells - 1})").cast("int")
    return ranked.select(F.col(column).alias(f"_value_{column}"), code.alias(f"_cell_{column}"))


def hilbert_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, curve, shard, slot and the cells.

    Dimensions: the rank of each category column and the logarithm of the text size (eight
    cells an octave). Ties on the curve are ordered by text checksum and id, so equal texts
    of equal metadata stand together.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"),
        *[F.col(c) for c in categories],
    )
    cells = []
    for c in categories:
        codes = broadcast_if_small(value_codes(docs, c, 1 << bits))
        slim = slim.join(codes, F.col(c).eqNullSafe(F.col(f"_value_{c}")), "left").drop(f"_value_{c}")
        cells.append(F.col(f"_cell_{c}"))
    size_cell = F.least(F.floor(F.log2("size") * 8), F.lit((1 << bits) - 1)).cast("int")
    slim = slim.withColumn("_cell_size", size_cell).withColumn("curve", curve_index([*cells, F.col("_cell_size")], bits))
    ranked = global_rank(
        slim.drop(*categories),
        [F.col("curve"), F.col("text_crc32"), F.col("doc_id"), F.col("size")],
        "_rank",
        "_total",
    )
    shard = F.expr(f"_rank * {shards} div _total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", F.col("_rank") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .drop("_rank", "_total")
    )


def shard_bounds(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and the range of every dimension per shard: what a reader prunes by."""
    dims = [c for c in sharded.columns if c.startswith("_cell_")]
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}{c.removeprefix('_cell')}") for c in dims for n, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """Write the documents as ``shard=N`` folders, in slot order inside a file.

    Ids must be unique. Rows are range-partitioned on (shard, slot), so a shard is written
    by several tasks in parallel, each a run of the curve.
    """
    placed = hilbert_shards(docs, id_col, **options).select(F.col("doc_id").alias(id_col), "shard", "slot")
    clean = docs.drop("shard", "slot")
    out = clean.join(placed, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
