"""Structured Streaming ingest of keyed JSON message batches.

The reference consumer polls the topic, keeps messages with a key and a JSON list
value, and inserts the list into a collection named after the key; anything else is
printed and dropped, and malformed JSON stops the consumer. Here:

* validation and decoding are column expressions over each micro-batch, read and parsed once;
* good items are exploded and appended to one table partitioned by ``status`` and
  ``collection``, each with its declared fields and, as ``document``, the whole item as it
  came; every rejected message, or item of a message, goes to the same table with its reason,
  under its own status, so one query feeds both and neither read touches the other's files;
* the sink is a file sink with a checkpoint, so each micro-batch is committed exactly once
  and a restart resumes from the last committed offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from funnelworks.sources import sinks

# Scraped product fields carried in a message.
PRODUCT_ITEM_SCHEMA = (
    "title string, brand string, price double, discount double, rating double, "
    "reviews bigint, availability string, detail map<string,string>"
)
ENVELOPE_SCHEMA = "key string, value string"

# Dead-letter reasons of messages, checked in this order, and of a single item.
REASONS = ("missing_key", "null_value", "malformed_json", "not_a_list", "bad_items")
ITEM_REASON = "bad_item"

# The column that holds an item as it was received.
DOCUMENT = "document"


def collection_name(key: str | Column) -> Column:
    """``key.replace(' ', '_').lower()`` (F16)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.lower(F.replace(k, F.lit(" "), F.lit("_")))


def _unfit(item: Column, item_schema: str) -> Column:
    """An item that is no object, or has a field, not null, that does not convert."""
    bad = ~F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))
    for f in T.StructType.fromDDL(item_schema).fields:
        path = f"$.{f.name}"
        raw = F.try_variant_get(item, path, "variant")
        typed = F.try_variant_get(item, path, f.dataType.simpleString())
        bad = bad | (raw.isNotNull() & ~F.is_variant_null(raw) & typed.isNull())
    return bad


def parse_envelopes(messages: DataFrame, item_schema: str = PRODUCT_ITEM_SCHEMA) -> DataFrame:
    """Decode key/value and classify each message: ``key, raw_key, value, elements, reason``.

    * key: bytes or text, empty → NULL (F15)
    * value: must be a non-empty JSON array (P10, D6); a single object is NOT accepted, unlike
      ``from_json`` which would wrap it
    * malformed JSON gives a reason instead of an exception (D10)
    * ``elements`` are the array's: ``bad`` ones are no objects or have a declared field that
      does not convert; the others have ``item``, the declared fields (missing ones NULL) and
      the whole element as JSON. A message without a single good element is rejected whole.
    """
    raw_key, text = F.col("key").cast("string"), F.col("value").cast("string")
    # Steps of their own: the optimiser does not copy the parse into the many uses below.
    decoded = messages.select(raw_key.alias("raw_key"), text.alias("value"), F.try_parse_json(text).alias("parsed"))

    def judged(x: Column) -> Column:
        typed = F.try_variant_get(x, "$", f"struct<{item_schema}>")
        names = T.StructType.fromDDL(item_schema).fieldNames()
        item = F.struct(*[typed[n].alias(n) for n in names], F.to_json(x).alias(DOCUMENT))
        return F.struct(_unfit(x, item_schema).alias("bad"), item.alias("item"))

    elements = F.transform(F.try_variant_get("parsed", "$", "array<variant>"), judged)
    read = decoded.select("raw_key", "value", F.schema_of_variant("parsed").alias("shape"), elements.alias("elements"))
    key, shape = F.nullif(F.col("raw_key"), F.lit("")), F.col("shape")
    reason = (
        F.when(key.isNull(), F.lit(REASONS[0]))
        .when(F.col("value").isNull(), F.lit(REASONS[1]))
        .when(shape.isNull(), F.lit(REASONS[2]))
        .when(~shape.startswith("ARRAY"), F.lit(REASONS[3]))
        .when(~F.exists("elements", lambda e: ~e["bad"]), F.lit(REASONS[4]))
    )
    return read.select(key.alias("key"), "raw_key", "value", "elements", reason.alias("reason"))


def routed_items(parsed: DataFrame) -> DataFrame:
    """One row per good item with its target ``collection``."""
    return routed_rows(parsed).where(F.col("status") == ACCEPTED).select("collection", "item.*")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Rejected messages as received (raw key) and rejected items, with their reason (T5)."""
    return routed_rows(parsed).where(F.col("status") == REJECTED).select("message.*")


ACCEPTED, REJECTED = "items", "dead_letters"
MESSAGE_SCHEMA = "key string, value string, reason string"


def routed_rows(parsed: DataFrame) -> DataFrame:
    """Rows of the ingest table: one an item, one a rejected message or item.

    ``status, collection, item, message``; ``item`` or ``message`` is NULL by the status. A
    choice per message, not a filter per output, so that a message is parsed once.
    """
    item_type = parsed.schema["elements"].dataType.elementType["item"].dataType
    no_item, no_message = F.lit(None).cast(item_type), F.lit(None).cast(f"struct<{MESSAGE_SCHEMA}>")
    collection = collection_name("key")

    def row(status: str, item: Column, message: Column) -> Column:
        place = collection if status == ACCEPTED else F.lit(None).cast("string")
        return F.struct(F.lit(status).alias("status"), place.alias("collection"), item.alias("item"), message.alias("message"))

    def of_element(e: Column) -> Column:
        odd = F.struct(F.col("raw_key").alias("key"), e["item"][DOCUMENT].alias("value"), F.lit(ITEM_REASON).alias("reason"))
        return F.when(e["bad"], row(REJECTED, no_item, odd)).otherwise(row(ACCEPTED, e["item"], no_message))

    message = F.struct(F.col("raw_key").alias("key"), "value", "reason")
    rows = F.when(F.col("reason").isNull(), F.transform("elements", of_element)).otherwise(F.array(row(REJECTED, no_item, message)))
    return parsed.select(F.inline(rows))


def spread_by_collection(rows: DataFrame) -> DataFrame:
    """Bring the rows of a collection together before the partitioned write.

    Without it every input task writes one file per collection it sees. The rebalance is
    sized from the batch at run time: small collections share a task, and one that holds
    most of a batch is split over as many tasks of the advisory size as it needs.
    """
    return rows.hint("rebalance", "status", "collection")


def kafka_source(
    spark: SparkSession, bootstrap_servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """The topic as a stream of ``key, value`` strings.

    ``max_offsets`` caps records per micro-batch (the reference polls 100); the default (no cap) lets a trigger take everything available,
    which is what a cluster wants. Results do not depend on it: the ingest is stateless.
    Needs the Spark Kafka connector on the classpath. Offsets are tracked by the query
    checkpoint (T3) instead of a consumer group.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    raw = reader.load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def envelope_file_source(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Envelope files (JSON lines ``{key, value}``) as a stream; the broker-less source."""
    return (
        spark.readStream.schema(ENVELOPE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )


def ingest_stream(
    source: DataFrame,
    out_path: str,
    checkpoint_path: str,
    item_schema: str = PRODUCT_ITEM_SCHEMA,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the one query that writes items and dead letters of a message stream (T4, T5).

    ``available_now`` processes what is there and stops (batch-like runs, tests);
    otherwise the query runs with the default micro-batch trigger. ``read_items`` and
    ``read_dead_letters`` give the two tables.
    """
    writer = (
        spread_by_collection(routed_rows(parse_envelopes(source, item_schema)))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .partitionBy("status", "collection")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(out_path)


def run_ingest(source: DataFrame, out_path: str, checkpoint_path: str, item_schema: str = PRODUCT_ITEM_SCHEMA) -> None:
    """Ingest everything available now and wait for the end (a failure raises)."""
    ingest_stream(source, out_path, checkpoint_path, item_schema).awaitTermination()


def _ingest_table(spark: SparkSession, out_path: str, item_schema: str) -> DataFrame:
    schema = f"item struct<{item_schema}, {DOCUMENT} string>, message struct<{MESSAGE_SCHEMA}>, status string, collection string"
    return sinks.read_back(spark, out_path, schema=schema)


def read_items(spark: SparkSession, out_path: str, item_schema: str = PRODUCT_ITEM_SCHEMA) -> DataFrame:
    """Ingested items with their ``collection`` and ``document``; a filter on the collection reads only that folder."""
    return _ingest_table(spark, out_path, item_schema).where(F.col("status") == ACCEPTED).select("collection", "item.*")


def read_dead_letters(spark: SparkSession, out_path: str, item_schema: str = PRODUCT_ITEM_SCHEMA) -> DataFrame:
    """Rejected messages as received, with their reason."""
    return _ingest_table(spark, out_path, item_schema).where(F.col("status") == REJECTED).select("message.*")
