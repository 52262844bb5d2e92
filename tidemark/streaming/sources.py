"""Message streams in and out. ``namespace`` and ``seq`` are the partition and its offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark import schemas
from tidemark.session import prepare
from tidemark.sources.events import encode_events


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, max_per_trigger: int = 1_000_000
) -> DataFrame:
    """A topic from its start. Needs the Kafka connector on the classpath."""
    records = (
        prepare(spark)
        .readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_per_trigger)
        .load()
    )
    return records.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("namespace"),
        F.col("offset").alias("seq"),
        F.current_timestamp().alias("arrival_time"),
        F.col("value").cast("string").alias("value"),
    )


def file_messages(
    spark: SparkSession,
    path: str,
    *,
    schema: str = schemas.RAW_MESSAGES,
    max_files_per_trigger: int = 64,
) -> DataFrame:
    """Messages or events landed as Parquet files, with their arrival time."""
    return (
        prepare(spark)
        .readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def as_messages(events: DataFrame) -> DataFrame:
    """Events keyed by entity id, as JSON."""
    return events.select(F.col("entity.id").alias("key"), encode_events(events).alias("value"))


def kafka_writer(
    events: DataFrame, servers: str, topic: str, checkpoint: str
) -> DataStreamWriter:
    return (
        as_messages(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
