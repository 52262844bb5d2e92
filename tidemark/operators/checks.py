"""Checks on single events: shape, future skew, lateness, ingestion lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import REQUEST_COMPLETED
from tidemark.functions.fields import Resolver, prepare_fields
from tidemark.functions.windows import add_millis
from tidemark.sources.events import WHOLE_NUMBER_FIELDS

FUTURE_SKEW_MS = 5 * 60_000
ALLOWED_LATENESS_MS = 10 * 60_000

ON_TIME = "ON_TIME"
LATE_WITHIN_ALLOWED = "LATE_WITHIN_ALLOWED"
TOO_LATE = "TOO_LATE"


def _blank(column: Column) -> Column:
    return column.isNull() | ~column.rlike(r"\S")


def envelope_problem() -> Column:
    return (
        F.when(_blank(F.col("event_id")), "blank_event_id")
        .when(_blank(F.col("event_type")), "blank_event_type")
        .when(F.col("event_time").isNull(), "no_event_time")
        .when(F.col("entity").isNull() | _blank(F.col("entity.type")), "blank_entity_type")
        .when(_blank(F.col("entity.id")), "blank_entity_id")
    )


def future_problem(now: Column, skew_ms: int = FUTURE_SKEW_MS) -> Column:
    return F.when(F.col("event_time") > add_millis(now, skew_ms), "future_event")


def request_problem(field: Resolver) -> Column:
    """What is wrong with a ``request.completed`` payload; null for other types.

    Numbers are judged after truncation, so ``-0.5`` counts as 0 and ``599.9`` as 599.
    """
    count, status, latency = (field(name) for name in WHOLE_NUMBER_FIELDS)
    problem = (
        F.when(~count.present, "count_missing")
        .when(~count.is_number, "count_not_numeric")
        .when(count.number <= -1, "count_negative")
        .when(status.present & ~status.is_number, "status_not_numeric")
        .when((status.number < 100) | (status.number >= 600), "status_out_of_range")
        .when(latency.present & ~latency.is_number, "latency_not_numeric")
        .when(latency.number <= -1, "latency_negative")
    )
    return F.when(F.col("event_type") == REQUEST_COMPLETED, problem)


def with_problem(events: DataFrame, now: Column) -> DataFrame:
    """Events with ``problem``: the first failing check, or null.

    A problem the source has set already is kept.
    """
    prepared, field = prepare_fields(events, WHOLE_NUMBER_FIELDS)
    found = F.coalesce(envelope_problem(), future_problem(now), request_problem(field))
    if "problem" in events.columns:
        found = F.coalesce(F.col("problem"), found)
    kept = [c for c in events.columns if c != "problem"]
    return prepared.select(*kept, found.alias("problem"))


def timing(
    event_time: Column, processing_time: Column, allowed_ms: int = ALLOWED_LATENESS_MS
) -> Column:
    """Lateness against the clock of arrival, not against a stream watermark."""
    cutoff = add_millis(processing_time, -allowed_ms)
    return (
        F.when(event_time < cutoff, TOO_LATE)
        .when(event_time < processing_time, LATE_WITHIN_ALLOWED)
        .otherwise(ON_TIME)
    )


def ingestion_lag_ms(event_time: Column, processing_time: Column) -> Column:
    lag = F.floor((F.unix_micros(processing_time) - F.unix_micros(event_time)) / 1000)
    return F.greatest(F.lit(0).cast("bigint"), lag.cast("bigint"))
