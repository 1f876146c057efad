"""The stored daily funnel kept up to date from slices of new events (A11 with S9).

All measures of the funnel are counts, sums, minima and maxima, so the rollup of old and new
events follows from the old rollup and that of the new events alone. ``apply_slice`` reads of
the stored table only the (category, day) partitions that the slice touches, and writes only
those again.

Layout under one root: ``data/slice=S/folder_category=C/folder_day=D/`` holds what slice S wrote;
a manifest, one row a partition, says which slice's folder is a partition's current one and is
published as a version of its own (``sinks.publish_version``). Readers see the table before a
slice or after it. A slice that stops half-way has published nothing and is simply run again; a
slice that has been applied is told by its name and changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.operators.joins import MAX_BROADCAST_ROWS
from funnelworks.operators.price_lists import FUNNEL_KEYS
from funnelworks.operators.rollups import daily_product_funnel
from funnelworks.session import drop_folder, list_folder
from funnelworks.sources import sinks

MEASURES = "view bigint, cart bigint, purchase bigint, n_prices bigint, n_null_prices bigint, min_price double, max_price double, sum_price double"
ROLLUP_SCHEMA = f"category string, event_day date, classification string, brand string, {MEASURES}"
PLACE_SCHEMA = "slice string, folder_category string, folder_day string"
MANIFEST_SCHEMA = f"kind string, {PLACE_SCHEMA}"
ADDED = ("view", "cart", "purchase", "n_prices", "n_null_prices", "sum_price")

# Slices are folder names.
SLICE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _folders() -> list[Column]:
    return [
        sinks.escape_partition(F.col("category")).alias("folder_category"),
        F.coalesce(F.col("event_day").cast("string"), F.lit(sinks.ESCAPE)).alias("folder_day"),
    ]


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows of kind ``partition`` (where it lies) and ``applied`` (a slice's name)."""
    if sinks.current_version(spark, f"{root}/manifest") is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return sinks.read_version(spark, f"{root}/manifest", MANIFEST_SCHEMA)


def _small(places: DataFrame) -> DataFrame:
    """Partition names: broadcast once a count shows that they are few."""
    return F.broadcast(places) if places.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else places


def _data(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """The stored rows of some partitions; folders of others are not read."""
    stored = spark.read.schema(f"{ROLLUP_SCHEMA}, {PLACE_SCHEMA}").parquet(f"{root}/data")
    return stored.join(_small(places), ["slice", "folder_category", "folder_day"], "left_semi")


def merged(rollups: DataFrame) -> DataFrame:
    """One rollup from the rows of several."""
    return rollups.groupBy(*FUNNEL_KEYS).agg(
        *[F.sum(c).alias(c) for c in ADDED], F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price")
    )


def apply_slice(events: DataFrame, root: str, name: str) -> bool:
    """Add a slice of events to the rollup under ``root``; False if it had been applied already."""
    if not SLICE_NAME.fullmatch(name):
        raise ValueError(f"a slice's name is letters, digits and . _ -, not {name!r}")
    spark = events.sparkSession
    manifest = _manifest(spark, root)
    if not manifest.where((F.col("kind") == "applied") & (F.col("slice") == name)).isEmpty():
        return False
    places = manifest.where("kind = 'partition'").drop("kind")
    fresh = f"{root}/data/slice={name}"
    # The slice's own rollup is stored first: what it touches is known from it without another scan.
    own = f"{root}/incoming/{name}"
    daily_product_funnel(events).write.mode("overwrite").parquet(own)
    rollup = spark.read.schema(ROLLUP_SCHEMA).parquet(own)
    touched = rollup.select(*_folders()).distinct()
    old = places.join(_small(touched), ["folder_category", "folder_day"], "left_semi")
    rows = rollup
    if not places.isEmpty():
        rows = rollup.unionByName(_data(spark, root, old).select(*rollup.columns))
    by_place = merged(rows).select("*", *_folders()).repartitionByRange("folder_category", "folder_day", "classification", "brand")
    by_place.sortWithinPartitions("folder_category", "folder_day", "classification", "brand").write.mode("overwrite").partitionBy(
        "folder_category", "folder_day"
    ).parquet(fresh)
    kept = places.join(_small(touched), ["folder_category", "folder_day"], "left_anti").select(*places.columns)
    moved = touched.select(F.lit(name).alias("slice"), "folder_category", "folder_day")
    applied = manifest.where("kind = 'applied'").unionByName(
        spark.range(1).select(F.lit("applied").alias("kind"), F.lit(name).alias("slice"), F.lit(None).cast("string").alias("folder_category"), F.lit(None).cast("string").alias("folder_day"))
    )
    now = kept.unionByName(moved).select(F.lit("partition").alias("kind"), "slice", "folder_category", "folder_day").unionByName(applied)
    sinks.publish_version(now, f"{root}/manifest", name)
    drop_folder(spark, own)
    return True


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The rollup as of the last slice that was applied."""
    places = _manifest(spark, root).where("kind = 'partition'").drop("kind")
    if places.isEmpty():
        return spark.createDataFrame([], ROLLUP_SCHEMA)
    return _data(spark, root, places).drop("slice", "folder_category", "folder_day")


def applied_slices(spark: SparkSession, root: str) -> DataFrame:
    return _manifest(spark, root).where("kind = 'applied'").select("slice")


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the slices' folders of which the manifest names no partition; their names.

    Readers that began before the last slice may still need them: run it when there are none.
    """
    used = {r.slice for r in _manifest(spark, root).where("kind = 'partition'").select("slice").distinct().collect()}
    gone = [f for f in list_folder(spark, f"{root}/data") if f.startswith("slice=") and f.removeprefix("slice=") not in used]
    for folder in gone:
        drop_folder(spark, f"{root}/data/{folder}")
    return [f.removeprefix("slice=") for f in gone]
