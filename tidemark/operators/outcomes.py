"""What became of each event: invalid, late, duplicate, processed or ignored.

The order of the checks is fixed: decode, validate, lateness, dedup, match. An event that a
matching declaration cannot use is invalid and leaves no dedup marker; an ignored event does
leave one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition
from tidemark.operators import dedup
from tidemark.operators.checks import (
    ALLOWED_LATENESS_MS,
    LATE_WITHIN_ALLOWED,
    TOO_LATE,
    ingestion_lag_ms,
    timing,
    with_problem,
)
from tidemark.plans.features import with_failure


def assess(events: DataFrame, allowed_ms: int = ALLOWED_LATENESS_MS) -> DataFrame:
    """Add ``problem`` (kept if the source already set one), ``timing`` and ``lag_ms``."""
    return (
        with_problem(events, F.col("arrival_time"))
        .withColumn("namespace", dedup.partition_namespace(F.col("namespace")))
        .withColumn(
            "timing",
            F.when(
                F.col("problem").isNull(),
                timing(F.col("event_time"), F.col("arrival_time"), allowed_ms),
            ),
        )
        .withColumn(
            "lag_ms",
            F.when(
                F.col("problem").isNull(),
                ingestion_lag_ms(F.col("event_time"), F.col("arrival_time")),
            ),
        )
    )


def reject_late(events: DataFrame, allowed_ms: int = ALLOWED_LATENESS_MS) -> DataFrame:
    """Drop too-late events, before dedup, so that they leave no marker."""
    late = timing(F.col("event_time"), F.col("arrival_time"), allowed_ms)
    return events.where(late != TOO_LATE)


def event_outcomes(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    *,
    allowed_ms: int = ALLOWED_LATENESS_MS,
    retention_ms: int = dedup.RETENTION_MS,
) -> DataFrame:
    """The events with ``outcome``, ``reason``, ``timing``, ``lag_ms``, ``late_accepted``."""
    checked = with_failure(assess(events, allowed_ms), definitions)
    on_time = F.col("problem").isNull() & (F.col("timing") != TOO_LATE)
    leaves_marker = checked.where(on_time & F.col("failure").isNull())
    taken = dedup.markers(leaves_marker, retention_ms)
    labelled = dedup.label(checked, taken, retention_ms)
    outcome = (
        F.when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("timing") == TOO_LATE, "late")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.col("failure").isNotNull(), "invalid")
        .when(F.col("supported"), "processed")
        .otherwise("ignored")
    )
    late_accepted = (
        F.col("problem").isNull()
        & (F.col("timing") == LATE_WITHIN_ALLOWED)
        & ~F.col("is_duplicate")
    )
    reason = F.when(outcome == "invalid", F.coalesce("problem", "failure"))
    added = ("problem", "timing", "lag_ms")
    return labelled.select(
        *[c for c in events.columns if c not in added],
        "timing",
        "lag_ms",
        outcome.alias("outcome"),
        reason.alias("reason"),
        late_accepted.alias("late_accepted"),
    )


def accepted(outcomes: DataFrame) -> DataFrame:
    """Events that feed features."""
    return outcomes.where(F.col("outcome") == "processed")
