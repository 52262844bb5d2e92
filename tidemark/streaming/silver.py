"""Messages -> outcome table: decode, validate, lateness, dedup, match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.definitions import FeatureDefinition
from tidemark.functions.fields import compute_once
from tidemark.operators.checks import ALLOWED_LATENESS_MS, LATE_WITHIN_ALLOWED, TOO_LATE
from tidemark.operators.dedup import RETENTION_MS
from tidemark.operators.monitoring import outcome_counters, outcome_counts
from tidemark.operators.outcomes import assess
from tidemark.plans.features import with_failure
from tidemark.sources.events import decode_events
from tidemark.streaming.batches import publish
from tidemark.streaming.dedup import ARRIVAL_DISORDER_MS, COMPACT_EVERY, MarkerTable, label_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTCOME_COLUMNS = [
    "namespace",
    "seq",
    "arrival_time",
    "event_id",
    "event_type",
    "event_time",
    "entity",
    "payload_json",
    "timing",
    "lag_ms",
    "late_accepted",
    "reason",
]


COUNTERS = (
    "received bigint, processed bigint, invalid bigint, ignored bigint, duplicate bigint, "
    "late bigint, late_accepted bigint, late_rejected bigint"
)


def require_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def judged(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    allowed_ms: int = ALLOWED_LATENESS_MS,
) -> DataFrame:
    """Every check that needs no state. ``verdict`` is final unless ``dedup`` is true."""
    checked = with_failure(assess(events, allowed_ms), definitions)
    late = F.col("timing") == TOO_LATE
    verdict = (
        F.when(F.col("problem").isNotNull(), "invalid")
        .when(late, "late")
        .when(F.col("failure").isNotNull(), "invalid")
        .when(F.col("supported"), "processed")
        .otherwise("ignored")
    )
    payload = (
        F.to_json("payload")
        if events.schema["payload"].dataType.simpleString() != "string"
        else F.col("payload")
    )
    return checked.select(
        *OUTCOME_COLUMNS[:7],
        payload.alias("payload_json"),
        "timing",
        "lag_ms",
        F.coalesce(F.col("timing") == LATE_WITHIN_ALLOWED, F.lit(False)).alias("late_accepted"),
        F.coalesce("problem", "failure").alias("reason"),
        verdict.alias("verdict"),
        (F.col("problem").isNull() & ~late).alias("dedup"),
        (F.col("problem").isNull() & ~late & F.col("failure").isNull()).alias("leaves_marker"),
    )


def settled(labelled: DataFrame) -> DataFrame:
    """Judged rows with ``is_duplicate`` -> outcome rows."""
    duplicate = F.col("is_duplicate") & F.col("dedup")
    return labelled.select(
        *[c for c in OUTCOME_COLUMNS if c not in ("late_accepted", "reason")],
        (F.col("late_accepted") & ~duplicate).alias("late_accepted"),
        F.when(~duplicate, F.col("reason")).alias("reason"),
        F.when(duplicate, "duplicate").otherwise(F.col("verdict")).alias("outcome"),
    )


def write_batch(
    rows: DataFrame, batch_id: int, path: str, retention_ms: int = RETENTION_MS, compact_every: int = COMPACT_EVERY
) -> None:
    """One micro-batch of judged rows -> its outcomes, counters and markers.

    Markers come last and are read by later batches only, so a batch that is run again, wherever it
    stopped, gives the same rows and changes nothing that is there.
    """
    spark = rows.sparkSession
    table = MarkerTable(spark, f"{path}.markers", retention_ms)
    rows = rows.persist()
    try:
        asked = rows.where(F.col("dedup"))
        final = rows.where(~F.col("dedup")).withColumn("is_duplicate", F.lit(False))
        labelled, taken = label_batch(asked, table, batch_id, retention_ms)
        outcomes = settled(final.unionByName(labelled)).withColumn("arrival_date", F.to_date("arrival_time"))
        counted = Observation()
        observed = outcomes.observe(counted, *outcome_counters())
        if publish(observed, path, batch_id, by=("arrival_date", "outcome")):
            counts = spark.createDataFrame([counted.get], COUNTERS)
        else:
            # Written by an attempt that went no further.
            written = spark.read.schema(outcomes.schema).parquet(f"{path}/batch_id={batch_id}")
            counts = outcome_counts(written).select(*T._parse_datatype_string(COUNTERS).names)
        publish(counts.coalesce(1), f"{path}.counters", batch_id)
        table.add(taken, batch_id)
        earliest = asked.agg(F.min(F.unix_millis("arrival_time"))).first()[0]
        if earliest is not None:
            table.drop_expired(earliest - ARRIVAL_DISORDER_MS)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact(batch_id)
    finally:
        rows.unpersist()


def write_outcomes(
    messages: DataFrame,
    definitions: Sequence[FeatureDefinition],
    path: str,
    checkpoint: str,
    *,
    allowed_ms: int = ALLOWED_LATENESS_MS,
    retention_ms: int = RETENTION_MS,
) -> StreamingQuery:
    """Decode messages and append their outcomes, every event exactly once.

    Beside ``path`` grow ``path.markers`` (live markers) and ``path.counters`` (one row of outcome
    counters per batch). All checks that need no state run in the stream's own plan.
    """
    rows = judged(decode_events(messages).drop("value"), definitions, allowed_ms)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path, retention_ms)

    return (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def counter_totals(counters: DataFrame) -> DataFrame:
    """Counters since the stream began, over its restarts."""
    names = T._parse_datatype_string(COUNTERS).names
    return counters.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def accepted_events(outcome_rows: DataFrame) -> DataFrame:
    """Outcome rows (table or stream) -> the events that feed features."""
    taken = outcome_rows.where(F.col("outcome") == "processed")
    parsed = compute_once(taken, F.try_parse_json("payload_json").alias("payload"))
    return parsed.drop("payload_json")
