"""Generic source/sink round trip.

The reference writes a dict row through a document-store connector, reads the
collection back with an inferred schema and filters it. The format is a parameter
here: any DataSource V1/V2 name on the classpath (parquet, json, orc, a document-store
or Kafka connector) goes through the same calls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def frame_from_records(
    spark: SparkSession, records: Sequence[Mapping], schema: StructType | str | None = None
) -> DataFrame:
    """Literal rows as a DataFrame (S4); pass a schema to skip inference."""
    return spark.createDataFrame([dict(r) for r in records], schema=schema)


def save(df: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str = "append",
         options: Mapping[str, str] | None = None) -> None:
    """``df.write.format(fmt).mode(mode).save()`` (S3)."""
    writer = df.write.format(fmt).mode(mode).options(**dict(options or {}))
    writer.save(path) if path else writer.save()


def load(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
         options: Mapping[str, str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """``spark.read.format(fmt).load()`` (S2); lazy, schema from the source unless given."""
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write_kafka(messages: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Send ``key, value`` rows to a topic in one distributed write.

    Needs the Spark Kafka connector on the classpath.
    """
    (
        messages.select(F.col("key").cast("string"), F.col("value").cast("string"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic)
        .save()
    )


def read_responses(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Stored search responses as ``response_id, body``.

    ``text``: one JSON document per line, kept as raw text so each document's shape is
    checked on its own (a schema inferred across documents would coerce list-shaped
    ``results`` and objects into one type). The id hashes the file name with the row
    position, which is stable while the files and the split size stay the same.
    """
    if fmt == "text":
        raw = spark.read.text(path)
    else:
        raw = spark.read.format(fmt).load(path).select(F.to_json(F.struct("*")).alias("value"))
    return raw.select(
        F.xxhash64(F.input_file_name(), F.monotonically_increasing_id()).alias("response_id"),
        F.col("value").alias("body"),
    )
