"""Event streams: declared sources, the gate, enrichment and the raw system of record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recloom.plans.recent import only_plays

WATERMARK = "10 minutes"
# Triggers are the arguments of ``DataStreamWriter.trigger``: this one ends with the input, and
# ``{"processingTime": "1 minute"}`` keeps a stream running.
ONCE = {"availableNow": True}


def file_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """New files under ``path`` (a folder or a glob) as a stream with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, rows_per_trigger: int) -> DataFrame:
    """JSON events of a Kafka topic. Needs the Kafka connector on the cluster's class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", rows_per_trigger)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def gate(events: DataFrame) -> DataFrame:
    """Only a PLAY that names an item reaches the activity features."""
    return only_plays(events)


def enrich_region(events: DataFrame, players: DataFrame, regions: DataFrame, default: str = "UK") -> DataFrame:
    """Fill in a missing market from the player (a stream-static join)."""
    home = players.join(regions.select("region_id", F.col("region_code").alias("_home")), "region_id").select(
        "player_id", "_home"
    )
    return (
        events.join(home, "player_id", "left")
        .withColumn("region_code", F.coalesce("region_code", "_home", F.lit(default)))
        .drop("_home")
    )


def drop_repeats(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each ``event_id`` once, as far back as the watermark; adds the event time as ``at``."""
    return (
        events.withColumn("at", F.col("event_ts").cast("timestamp"))
        .withWatermark("at", watermark)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def append_raw(events: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Append a stream to the raw event table, exactly once."""
    return (
        events.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or ONCE))
        .start(path)
    )


def with_hook(events: DataFrame, transform) -> DataFrame:
    """Apply a frame-to-frame function, the extension point of a stream feature."""
    return events.transform(transform)
