"""Table sinks.

The reference writes one document at a time into a collection chosen from the data.
Here every sink is one distributed write: the collection becomes a partition column,
batching becomes the task writers, and re-runs are idempotent where the reference
duplicated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelworks.session import drop_others, path_exists, read_text, replace_text

# A partition folder cannot hold the empty text (it reads back as NULL), so that value and
# those that would collide with it are stored behind this sign.
ESCAPE = "~"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def escape_partition(c: Column) -> Column:
    """A partition value as it is stored; NULL stays NULL."""
    special = c.isin("", NULL_FOLDER) | c.startswith(ESCAPE)
    return F.when(special, F.concat(F.lit(ESCAPE), c)).otherwise(c)


def restore_partition(c: Column) -> Column:
    return F.when(c.startswith(ESCAPE), F.substring(c, 2, 1 << 30)).otherwise(c)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_col: str,
    sort_cols: Sequence[str] = (),
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> str:
    """One output partition per value of ``partition_col`` (S9: collection per category).

    Rows are range-partitioned on ``(partition_col, *sort_cols)`` rather than hashed on
    ``partition_col`` alone: a category holding a third of all rows is spread over many
    writer tasks (sampled range bounds), each writing a few sorted files, while small
    categories still land in one file. Files are as large as the writers' share of the data.
    Text values go through ``escape_partition``; ``read_back`` restores them.
    """
    if df.schema[partition_col].dataType.simpleString() == "string":
        df = df.withColumn(partition_col, escape_partition(F.col(partition_col)))
    ordered = df.repartitionByRange(partition_col, *sort_cols).sortWithinPartitions(
        partition_col, *sort_cols
    )
    (
        ordered.write.mode(mode)
        .format(fmt)
        .partitionBy(partition_col)
        .save(path)
    )
    return path


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append (S11/S15: the bulk insert); every task writes its share as one file."""
    df.write.mode("append").format(fmt).save(path)
    return path


def overwrite_partitions(df: DataFrame, path: str, partition_col: str, fmt: str = "parquet") -> str:
    """Replace only the partitions present in ``df`` (S12); the others stay as they are.

    Dynamic partition overwrite makes a re-run rewrite the same partitions instead of
    appending duplicates.
    """
    (
        df.write.mode("overwrite")
        .format(fmt)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col)
        .save(path)
    )
    return path


def read_back(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    partition_col: str | None = None,
) -> DataFrame:
    """Read a written table. Pass the written schema so partition values keep their type
    (a collection named ``"2024"`` stays a string instead of being inferred as a number),
    and ``partition_col`` to restore the values of a text column that ``write_partitioned``
    stored; a filter on it still prunes folders."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    out = reader.load(path)
    if partition_col:
        out = out.withColumn(partition_col, restore_partition(F.col(partition_col)))
    return out


def read_partition(spark: SparkSession, path: str, partition_col: str, value: str, schema: StructType | str) -> DataFrame:
    """The rows of one value of a text column of a ``write_partitioned`` table.

    The folder's name follows from the value, so no other folder is listed; none gives no rows.
    """
    special = value in ("", NULL_FOLDER) or value.startswith(ESCAPE)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = f"{path}/{names.escapePathName(partition_col)}={names.escapePathName(ESCAPE + value if special else value)}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(folder)
    return rows.withColumn(partition_col, F.lit(value))


def publish_version(df: DataFrame, root: str, version: str) -> str:
    """Write a table as one version under ``root`` and make it the one ``read_version`` reads.

    The version's folder is written first and its name then put in place by a rename, so a
    reader sees the old version or the new one, whole. Writing a version again replaces it.
    The version before the current one stays for readers that are under way; older ones go.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    before = current_version(spark, root)
    if before == version:
        return version
    replace_text(spark, f"{root}/current", "\n".join([version, *([before] if before else [])]))
    drop_others(spark, f"{root}/versions", {version, before})
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the published version, if there is one."""
    text = read_text(spark, f"{root}/current")
    return text.split("\n")[0] if text else None


def read_version(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame:
    """The published version of a table."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published version under {root}")
    return read_back(spark, f"{root}/versions/{version}", schema=schema)


def stored_footprint(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """On-disk size of a written table: ``n_files, n_bytes`` (S14, the storage-size probe).

    Read from the file-metadata column, so only file footers are touched and the count
    runs as a Spark job, not as a listing on the driver.
    """
    files = spark.read.format(fmt).load(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")
    ).distinct()
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("n_bytes")
    )
