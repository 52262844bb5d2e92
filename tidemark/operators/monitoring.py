"""Counters, rates and quantiles over the outcome table and over reads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress

from tidemark.definitions import FeatureDefinition
from tidemark.functions.keys import feature_key
from tidemark.functions.quantiles import nearest_rank
from tidemark.functions.values import number_text
from tidemark.functions.windows import tumbling_start

RATE_WINDOW_MS = 300_000


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def _counters() -> dict[str, Column]:
    late = F.count_if(_is("late"))
    return {
        "received": F.count(F.lit(1)),
        "processed": F.count_if(_is("processed")),
        "invalid": F.count_if(_is("invalid")),
        "ignored": F.count_if(_is("ignored")),
        "duplicate": F.count_if(_is("duplicate")),
        "late": late,
        "late_accepted": F.count_if("late_accepted"),
        "late_rejected": late,
    }


def outcome_counters() -> list[Column]:
    """The counters of outcomes as named aggregates, for tables and for observed streams."""
    return [c.alias(n) for n, c in _counters().items()]


def outcome_counts(outcomes: DataFrame, *keys: str) -> DataFrame:
    return outcomes.groupBy(*keys).agg(*outcome_counters())


def outcome_rates(outcomes: DataFrame, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """Events per second of arrival windows; only windows with arrivals appear."""
    seconds = F.lit(window_ms / 1000.0)
    start = tumbling_start(F.col("arrival_time"), window_ms).alias("window_start")
    shown = ("received", "processed", "invalid", "duplicate", "late", "late_accepted")
    counters = _counters()
    return outcomes.groupBy(start).agg(
        *[(counters[name] / seconds).alias(f"{name}_per_second") for name in shown]
    )


def lag_quantiles(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Ingestion lag of every decodable valid event, late ones and duplicates included."""
    return nearest_rank(outcomes, keys, "lag_ms")


def freshness_quantiles(reads: DataFrame, *keys: str) -> DataFrame:
    floored = F.greatest(F.lit(0).cast("bigint"), F.col("freshness_ms"))
    return nearest_rank(
        reads.withColumn("freshness_ms", F.when(F.col("freshness_ms").isNotNull(), floored)),
        keys,
        "freshness_ms",
    )


def read_status_counts(reads: DataFrame, *keys: str) -> DataFrame:
    return reads.groupBy(*keys, F.lower("status").alias("status")).agg(
        F.count(F.lit(1)).alias("reads")
    )


def feature_state_entries(rows: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Feature rows as the keys and values a store of their state holds, as text.

    Averages and ratios keep two numbers, all else one.
    """
    pairs = sorted({d.name for d in definitions if d.aggregation in ("AVG", "RATIO")})
    key = feature_key(
        F.col("entity_type"), F.col("entity_id"), F.col("feature_name"), F.col("window_start")
    )
    pair = F.concat_ws(",", number_text(F.col("num")), number_text(F.col("den")))
    return rows.select(
        key.alias("key_text"),
        F.when(F.col("feature_name").isin(pairs), pair)
        .otherwise(number_text(F.col("num")))
        .alias("state_text"),
    )


def state_size(entries: DataFrame, *keys: str) -> DataFrame:
    """Bytes of keys and values; ``entries`` has ``key_text`` and ``state_text``."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.octet_length("key_text")), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.sum(F.octet_length("state_text")), F.lit(0)).alias("value_bytes"),
    )


def stream_state_entries(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """What a stateful stream keeps now, read from its checkpoint as a table, for ``state_size``."""
    entries = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return entries.select(
        "partition_id",
        F.to_json("key").alias("key_text"),
        F.to_json("value").alias("state_text"),
    )


# The figures of one stateful operator after one micro-batch.
FOOTPRINT = (
    "query string, batch_id bigint, operator int, name string, entries bigint, updated bigint, "
    "removed bigint, dropped_late bigint, memory_bytes bigint"
)


def state_footprint(spark: SparkSession, progress: Iterable[StreamingQueryProgress]) -> DataFrame:
    """One row per reported micro-batch and stateful operator (``query.recentProgress``, or what a
    listener was given). Partitions sum up their own figures; nothing is read here."""
    rows = [
        (
            str(p.id),
            p.batchId,
            number,
            s.operatorName,
            s.numRowsTotal,
            s.numRowsUpdated,
            s.numRowsRemoved,
            s.numRowsDroppedByWatermark,
            s.memoryUsedBytes,
        )
        for p in progress
        for number, s in enumerate(p.stateOperators)
    ]
    return spark.createDataFrame(rows, FOOTPRINT)
