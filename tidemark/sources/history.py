"""The append-only history of events in flat columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import resolve
from tidemark.functions.values import to_long
from tidemark.sources.events import encode_events
from tidemark.streaming.batches import Folder, publish

DEFAULT_PHASE = "measurement"


def history_rows(
    events: DataFrame, run_id: Column | None = None, phase: Column | None = None
) -> DataFrame:
    """Events as history rows. A payload number that is missing or no number becomes 0."""

    def whole(path: str) -> Column:
        return F.coalesce(to_long(resolve(events.schema, path).number), F.lit(0).cast("bigint"))

    nothing = F.lit(None).cast("string")
    return events.select(
        "event_id",
        (nothing if run_id is None else run_id).alias("benchmark_run_id"),
        (nothing if phase is None else phase).alias("benchmark_phase"),
        "event_type",
        "event_time",
        F.col("entity.type").alias("entity_type"),
        F.col("entity.id").alias("entity_id"),
        whole("count").alias("count_value"),
        whole("statusCode").cast("int").alias("status_code"),
        whole("latencyMs").alias("latency_ms"),
        encode_events(events).alias("event_json"),
    )


def new_rows(
    batch: DataFrame, stored: DataFrame | None, order_by: Sequence[str]
) -> DataFrame:
    """Rows of ``batch`` an idempotent append adds: first per new event id.

    Stored ids leave before copies are looked at. Then the first row per id is kept by rank, on the
    map side too (Spark limits each group before the shuffle), so a much-repeated id moves as one
    row per task and no row is packed into an aggregation buffer.
    """
    if stored is not None:
        batch = batch.join(stored.select("event_id"), "event_id", "left_anti").select(*batch.columns)
    first = Window.partitionBy("event_id").orderBy(*order_by)
    rank = "_rank"
    while rank in batch.columns:
        rank += "_"
    return batch.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)


def append_history(rows: DataFrame, path: str) -> None:
    """Append, laid out by day so that time ranges prune folders."""
    (
        rows.withColumn("event_date", F.to_date("event_time"))
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def append_batch(
    rows: DataFrame,
    path: str,
    batch_id: int,
    order_by: Sequence[str],
    *,
    copies_keep_day: bool = False,
) -> bool:
    """Append the events of a batch that no other batch has brought; False if the batch is there.

    Look-up, reduction and write are one job, and the batch appears whole, by a rename: a batch that
    is run again, wherever its first run stopped, adds nothing twice. One writer at a time. The
    history is read for its ids only. With ``copies_keep_day`` (copies of an event carry its time, as
    redelivered messages do) only the days from the batch's first to its last are read, found in a
    pass of their own over the batch's times.
    """
    spark = rows.sparkSession
    table = Folder(spark, path)
    if table.child(f"batch_id={batch_id}").exists():
        return False
    dated = rows.withColumn("event_date", F.to_date("event_time"))
    stored = None
    if table.names():
        layout = T.StructType([*dated.schema, T.StructField("batch_id", T.LongType())])
        stored = spark.read.schema(layout).parquet(path)
        if copies_keep_day:
            first, last = dated.agg(F.min("event_date"), F.max("event_date")).first()
            stored = stored.where(F.col("event_date").between(first, last) | F.col("event_date").isNull())
    return publish(new_rows(dated, stored, order_by), path, batch_id, by=("event_date",))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def effective_phase(run_id: str | None, phase: str | None) -> str | None:
    """A run without a named phase means its measurement phase."""
    if phase and phase.strip():
        return phase
    return DEFAULT_PHASE if run_id and run_id.strip() else None


def scan_history(
    history: DataFrame,
    *,
    event_type: str,
    entity_type: str | None = None,
    entity_id: str | None = None,
    run_id: str | None = None,
    phase: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """Plain column predicates, all of which reach the file scan."""
    wanted = {
        "event_type": event_type,
        "entity_type": entity_type,
        "entity_id": entity_id,
        "benchmark_run_id": run_id,
        "benchmark_phase": effective_phase(run_id, phase),
    }
    for column, literal in wanted.items():
        if literal and literal.strip():
            history = history.where(F.col(column) == literal)
    if since is not None:
        history = history.where(F.col("event_time") >= since)
        if "event_date" in history.columns:
            history = history.where(F.col("event_date") >= F.to_date(since))
    if until is not None:
        history = history.where(F.col("event_time") < until)
        if "event_date" in history.columns:
            history = history.where(F.col("event_date") <= F.to_date(until))
    return history
