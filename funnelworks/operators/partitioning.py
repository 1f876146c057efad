"""Task counts. Nothing here runs a job or looks at the data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
