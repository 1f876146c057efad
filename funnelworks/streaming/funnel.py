"""The daily product funnel as a stream over event time (XT1 of the operator inventory).

The rollup of ``operators.rollups`` kept up to date from a stream of events: one-day windows on
the event time, a watermark that says how late an event may come, and the groups of the open
days in the state store. Tasks combine their events before the state is touched, so a hot group
costs a row a task and batch.

* ``append``: a day is written once, when the watermark has passed its end; state holds the open
  days only. An event later than the watermark is left out and counted in the query's progress
  (``late_events``).
* ``complete``: after every batch the whole rollup so far is published as one version, by
  writing a folder of its own and then the name of that folder; nothing is ever late.

A restart goes on from the checkpoint: offsets, state and, for ``append``, the sink's commit
log belong to the same batch. A batch that is replayed writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from funnelworks.functions.paths import classification, top_category
from funnelworks.operators.rollups import FUNNEL_KEYS, price_summary, stage_counts
from funnelworks.sources import sinks

EVENT_SCHEMA = "event_time timestamp, event_type string, category_code string, brand string, price double"
FUNNEL_SCHEMA = (
    "category string, event_day date, classification string, brand string, view bigint, cart bigint, purchase bigint, "
    "n_prices bigint, n_null_prices bigint, min_price double, max_price double, sum_price double"
)
DELAY = "1 day"


def event_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files that arrive in a folder, as a stream of ``EVENT_SCHEMA``."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def land_events(events: DataFrame, path: str) -> str:
    """Append events to such a folder, in ``EVENT_SCHEMA``."""
    columns = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(EVENT_SCHEMA).fields]
    events.select(*columns).write.mode("append").parquet(path)
    return path


def daily_funnel_stream(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The funnel of a stream of events, by event day; columns of ``FUNNEL_SCHEMA``.

    Events without a category or a time take no part.
    """
    rows = events.withWatermark("event_time", delay).select(
        "event_time",
        top_category("category_code").alias("category"),
        classification("category_code").alias("classification"),
        "brand",
        "event_type",
        "price",
    )
    grouped = rows.where(F.col("category").isNotNull()).groupBy(
        F.window("event_time", "1 day").alias("day"), "category", "classification", "brand"
    )
    out = grouped.agg(*stage_counts(), *price_summary())
    measures = [f.name for f in T.StructType.fromDDL(FUNNEL_SCHEMA).fields if f.name not in FUNNEL_KEYS]
    return out.select("category", F.to_date("day.start").alias("event_day"), "classification", "brand", *measures)


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_days(events: DataFrame, out_path: str, checkpoint_path: str, delay: str = DELAY, available_now: bool = True) -> StreamingQuery:
    """Write every day once it is closed, a folder a day (``append`` mode)."""
    writer = (
        daily_funnel_stream(events, delay)
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .partitionBy("event_day")
    )
    return _start(writer, available_now)


def read_days(spark: SparkSession, out_path: str) -> DataFrame:
    """The closed days."""
    return spark.read.schema(FUNNEL_SCHEMA).parquet(out_path)


def publish_totals(events: DataFrame, out_path: str, checkpoint_path: str, delay: str = DELAY, available_now: bool = True) -> StreamingQuery:
    """Publish the whole rollup after every batch (``complete`` mode)."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        sinks.publish_version(batch, out_path, f"batch-{batch_id}")

    writer = (
        daily_funnel_stream(events, delay)
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("complete")
    )
    return _start(writer, available_now)


def late_events(query: StreamingQuery) -> int:
    """Rows of groups left out because their day was closed, over the query's kept progress."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
