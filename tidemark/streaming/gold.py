"""Accepted events -> feature changelog, and the views over it.

All declarations share one stateful aggregation over panes, as long as the greatest common divisor
of all their windows and slides. A pane leaves the state once it is behind the watermark, so the state
holds the open panes only, however long the windows are; unwindowed features keep none for good. A
micro-batch appends the state of the panes it touched under its batch id; a retry overwrites only
its own folder. Windows are put together from panes when the changelog is read.

Distinct counts need no set in the state: the distinct value is part of the state key, and the
view counts keys. A checkpoint belongs to one set of declarations.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.definitions import FeatureDefinition
from tidemark.functions.windows import floor_to, pane_starts
from tidemark.operators.checks import ALLOWED_LATENESS_MS, FUTURE_SKEW_MS
from tidemark.plans.features import (
    ENTITY_KEYS,
    FEATURE_KEYS,
    Group,
    active_only,
    annotate,
    explode_groups,
    finish,
    group_definitions,
    identity,
    merge_partials,
    own_pane,
    slot_sums,
    unpivot_slots,
)

# The newest accepted event may be ahead of the clock by the skew, the oldest behind it by the
# allowed lateness: with less, the watermark would drop events the lateness check accepts.
WATERMARK_MS = ALLOWED_LATENESS_MS + FUTURE_SKEW_MS


# Panes of a stream that has unwindowed features only.
TOTAL_PANE_MS = 3_600_000


def stream_pane(groups: Sequence[Group]) -> int:
    """Millis that are together in every window of every group."""
    return math.gcd(*[g.pane for g in groups if g.pane is not None]) or TOTAL_PANE_MS


def feature_changes(
    accepted: DataFrame,
    definitions: Sequence[FeatureDefinition],
    watermark_ms: int = WATERMARK_MS,
) -> DataFrame:
    """A stream of accepted events -> the changed state of every pane they touch.

    One stateful operator over one read of the source, however many kinds of window there are:
    ``window_start`` is the start of the pane.
    """
    groups = group_definitions(definitions)
    marked = accepted.withWatermark("event_time", f"{watermark_ms} milliseconds")
    exploded = explode_groups(
        annotate(marked, definitions), groups, carry=("event_time",), with_panes=False
    )
    keys = [*ENTITY_KEYS, "group_id"]
    if "distinct_value" in exploded.columns:
        keys.append("distinct_value")
    width = max(len(g.members) for g in groups)
    pane = F.window("event_time", f"{stream_pane(groups)} milliseconds").alias("pane")
    grouped = exploded.groupBy(*keys, pane).agg(*slot_sums(width))
    return unpivot_slots(grouped.withColumn("window_start", F.col("pane.start")), groups)


def write_changelog(
    accepted: DataFrame,
    definitions: Sequence[FeatureDefinition],
    path: str,
    checkpoint: str,
    watermark_ms: int = WATERMARK_MS,
) -> StreamingQuery:
    def append(changes: DataFrame, batch_id: int) -> None:
        panes = changes.withColumn("settled", F.lit(False))
        panes.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        feature_changes(accepted, definitions, watermark_ms)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(availableNow=True)
        .start()
    )


def pane_state(changelog: DataFrame) -> DataFrame:
    """The last written state per key and pane, by batch id."""
    values = ("n", "num", "den", "updated_at")
    return changelog.groupBy(*FEATURE_KEYS, "distinct_value", "settled").agg(
        *[F.max_by(c, "batch_id").alias(c) for c in values]
    )


def _one_of(identities: Sequence[Column]) -> Column:
    return F.struct("feature_name", "definition_version").isin(list(identities))


def _lengths(
    definitions: Sequence[FeatureDefinition], of: Callable[[FeatureDefinition], int | None]
) -> Column:
    """A length in millis by the declaration of a row; null where ``of`` gives None."""
    alike: dict[int, list[Column]] = {}
    for d in active_only(definitions):
        if of(d) is not None:
            alike.setdefault(of(d), []).append(identity(d))
    length = F.lit(None).cast("bigint")
    for millis, members in alike.items():
        length = F.when(_one_of(members), F.lit(millis).cast("bigint")).otherwise(length)
    return length


def _slide(d: FeatureDefinition) -> int | None:
    return d.slide if d.window_type == "SLIDING" else d.window


def feature_state(changelog: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Changelog -> state per window, as ``partials`` over all accepted events gives it.

    Rows of declarations that are not active are left out.
    """
    size, slide = _lengths(definitions, lambda d: d.window), _lengths(definitions, _slide)
    starts = F.when(size.isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(
        pane_starts(F.unix_millis("window_start"), size, slide)
    )
    known = changelog.where(_one_of([identity(d) for d in active_only(definitions)]))
    panes = pane_state(known)
    windows = panes.select(
        *[c for c in panes.columns if c not in ("window_start", "settled")],
        F.explode(starts).alias("start_ms"),
    )
    return merge_partials(windows.withColumn("window_start", F.timestamp_millis("start_ms")))


def feature_rows(changelog: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Changelog -> feature rows, as a batch run over all accepted events would give."""
    return finish(feature_state(changelog, definitions), definitions)


def compact(
    spark: SparkSession,
    path: str,
    target: str,
    definitions: Sequence[FeatureDefinition] = (),
    finished_before: dt.datetime | None = None,
) -> None:
    """Write the changelog's current state to a new changelog folder.

    Rows keep the newest batch id, so that later batches of the stream still win. With
    ``finished_before`` (the stream's watermark, or any time before it) panes that ended by then and
    can't change any more are merged into the longest panes of their declaration: whole tumbling
    windows, and one row for all of an unwindowed feature. Rows of declarations that are not active
    stay as they are.
    """
    changelog = spark.read.parquet(path)
    newest = changelog.agg(F.max("batch_id")).first()[0]
    state = pane_state(changelog)
    if finished_before is not None:
        pane = stream_pane(group_definitions(definitions))
        ends = F.unix_millis("window_start") + F.lit(pane)
        done = F.col("settled") | (ends <= F.unix_millis(F.lit(finished_before)))
        done = done & _one_of([identity(d) for d in active_only(definitions)])
        length = _lengths(definitions, own_pane)
        start = F.timestamp_millis(floor_to(F.unix_millis("window_start"), length))
        merged = merge_partials(
            state.where(done).withColumn("window_start", start).drop("settled")
        )
        state = state.where(~done).unionByName(merged.withColumn("settled", F.lit(True)))
    state.write.mode("overwrite").parquet(f"{target}/batch_id={newest}")
