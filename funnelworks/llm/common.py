"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import itertools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelworks.session import checkpoint_root, noted, shared_path

# A table is broadcast only after a count has shown it to have at most this many rows.
BROADCAST_ROWS = 200_000

# Rows per Arrow batch that row-expanding tasks hand back to the JVM at a time.
OUT_ROWS = 50_000

# Rows of an incoming Arrow batch that are Python objects at a time.
IN_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table by Spark's own reader (the folder may be in any Hadoop store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    out = df.checkpoint()
    noted(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint root and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_in_buckets(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``store`` with the rows in buckets by ``key``: the plain table, and one whose rows are not
    moved by a join on ``key`` with as many partitions. Spark reads buckets by a table's name
    alone, which is dropped at once; the files stay."""
    spark = df.sparkSession
    path, entry = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(entry, format="parquet")
    bucketed = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return spark.read.schema(df.schema).parquet(path), bucketed


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count proves the bound; otherwise leave the join to AQE.

    ``df`` must be cheap to count (materialised, or an aggregate over few groups).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def global_rank(df: DataFrame, order: Sequence[str | Column], rank: str, total: str) -> DataFrame:
    """Gapless global positions (from 0) in the given order, and the row count.

    Rows are range-partitioned and sorted, numbered inside their partition and fixed by a
    checkpoint; the offset of a partition is the sum of the earlier partitions' counts, a
    table of one row per partition. No task sees more than its own range, and equal keys
    may fall in several ranges if ``order`` ends in a unique column.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(
        ranged.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
        )
    )
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(everything).alias(total),
    )
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + F.col("_pos"))
        .drop("_part", "_pos", "_before")
    )


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few of one batch in memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, IN_ROWS).columns), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size`` rows."""
    rows = iter(rows)
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(col, type=f.type) for col, f in zip(zip(*chunk, strict=True), schema, strict=True)],
            schema=schema,
        )


def _workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Only matters where the package is neither installed nor shipped with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


# Rows of the Arrow batches that tasks get. Spark's 10,000 rows of text are tens of MB on
# both sides of the pipe for every task.
ARROW_ROWS = 1000
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPARK_ARROW_ROWS = "10000"


def _small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size, unless its user has set one."""
    if spark.conf.get(ARROW_SETTING) == SPARK_ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))


def _give_back_memory() -> None:
    """Hand a worker's free memory back, as it stays alive idle after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, size: int = OUT_ROWS) -> DataFrame:
    """Run a generator over the rows of each partition, in Arrow batches both ways."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    _workers_find_package(df.sparkSession)
    _small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(fn(rows_of(batches)), arrow, size)
        _give_back_memory()

    return df.mapInArrow(run, schema)
