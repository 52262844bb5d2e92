"""Summaries of recorded operations: latency, failures, throughput, availability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import LATENCY_PERCENTILES, ranks, value_counts
from tidemark.functions.windows import add_millis

EVENT_PUBLISH = "event_publish"
FEATURE_READ = "feature_read"


def latency_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, extremes and nearest-rank percentiles of ``latency_ms`` per key.

    Keys whose operations all lack a latency have no row; without keys there is always one,
    of zeros if need be.
    """
    counts = value_counts(rows, keys, "latency_ms")
    zero = F.lit(0).cast("bigint")
    seen = F.coalesce(F.sum("_c"), zero)
    basics = counts.groupBy(*keys).agg(
        seen.alias("count"),
        F.coalesce(
            F.try_divide(F.sum(F.col("_v") * F.col("_c")).cast("double"), seen), F.lit(0.0)
        ).alias("avg_ms"),
        F.coalesce(F.min("_v"), zero).alias("min_ms"),
        F.coalesce(F.max("_v"), zero).alias("max_ms"),
    )
    return _beside(basics, ranks(counts, keys), keys).select(
        *keys,
        "count",
        "avg_ms",
        "min_ms",
        *[F.coalesce(p, zero).alias(f"{p}_ms") for p in LATENCY_PERCENTILES],
        "max_ms",
    )


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which any may be null; each side has a key at most once."""
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    return left.join(renamed, same, "left").drop(*[f"_right_{c}" for c in keys])


def _operation_figures() -> list[Column]:
    succeeded, total = F.count_if("success"), F.count(F.lit(1))
    failed = total - succeeded
    return [
        total.alias("total"),
        succeeded.alias("successes"),
        failed.alias("failures"),
        F.coalesce(F.try_divide(failed.cast("double"), total), F.lit(0.0)).alias("error_rate"),
        F.count_if((F.col("status_code") < 200) | (F.col("status_code") >= 300)).alias(
            "http_non_2xx"
        ),
        F.count_if("timeout").alias("timeouts"),
    ]


def operation_summary(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_operation_figures())


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Reads per feature status; operations without one are not counted."""
    return (
        rows.where(F.col("feature_status").isNotNull())
        .groupBy(*keys, "feature_status")
        .agg(F.count(F.lit(1)).alias("operations"))
    )


def throughput(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Achieved against target rates per (phase, type).

    ``targets``: phase, type, rate_per_second, duration_seconds, slo_ms. Publishes count when
    they succeed, reads always. The elapsed time is that of the whole phase. A target is
    sustained if enough operations completed and their p95 is within the limit.
    """
    elapsed = rows.groupBy("phase").agg(
        (
            (
                F.max(F.unix_micros(add_millis(F.col("started_at"), F.col("latency_ms"))))
                - F.min(F.unix_micros("started_at"))
            )
            / 1_000_000
        ).alias("elapsed_seconds")
    )
    counts = operation_summary(rows, "phase", "type").select(
        "phase",
        "type",
        F.when(F.col("type") == EVENT_PUBLISH, F.col("successes"))
        .otherwise(F.col("total"))
        .alias("completed"),
    )
    p95 = latency_summary(rows, "phase", "type").select("phase", "type", "count", "p95_ms")
    target_operations = F.col("rate_per_second") * F.floor("duration_seconds")
    return (
        targets.join(counts, ["phase", "type"], "left")
        .join(p95, ["phase", "type"], "left")
        .join(elapsed, "phase", "left")
        .select(
            "phase",
            "type",
            target_operations.cast("bigint").alias("target_operations"),
            F.coalesce("completed", F.lit(0)).alias("completed_operations"),
            F.coalesce(F.try_divide(F.col("completed"), F.col("elapsed_seconds")), F.lit(0.0))
            .alias("completed_per_second"),
            (
                (F.coalesce("completed", F.lit(0)) >= target_operations)
                & (
                    (F.coalesce("count", F.lit(0)) == 0)
                    | (F.col("p95_ms") <= F.col("slo_ms"))
                )
            ).alias("sustained"),
        )
    )


def phase_summary(rows: DataFrame) -> DataFrame:
    """Latency, operation and read-status figures per (phase, type) in one table."""
    keys = ["phase", "type"]
    statuses = [
        F.count_if(F.col("feature_status") == s).alias(s.lower())
        for s in ("PRESENT", "STALE", "MISSING", "UNAVAILABLE")
    ]
    operations = rows.groupBy(*keys).agg(*_operation_figures(), *statuses)
    return _beside(operations, latency_summary(rows, *keys).drop("count"), keys)


def availability(
    probes: DataFrame, increases: DataFrame, timeout_ms: int, keys: Sequence[str]
) -> DataFrame:
    """How long after its acknowledgement an update became visible.

    ``probes``: ``keys``, probe_id, started_at, ack_at. ``increases``: ``keys``, updated_at of
    every change that raised the value. Visible is the first raise at or after the start of
    the probe; the latency counts from the acknowledgement and is null on timeout.

    Forward as-of by time cells as long as the search reach: a probe looks into its own cell
    and the next one, so an entity with very many rows is spread over its cells, and one
    ordered pass per cell finds the next raise without pairing probes with changes.
    """
    keys = list(keys)
    reach = timeout_ms
    start = F.unix_micros("started_at")
    deadline = F.unix_micros("ack_at") + F.lit(timeout_ms * 1000)
    longest = F.lit(reach * 1000)
    cell_of = lambda micros: F.floor(micros / longest)
    last_cell = cell_of(deadline)
    looking = probes.select(
        *keys,
        F.explode(F.sequence(cell_of(start), last_cell)).alias("cell"),
        start.alias("at"),
        F.lit(1).alias("is_probe"),
        "probe_id",
        F.unix_micros("ack_at").alias("ack_us"),
    )
    raising = increases.select(
        *keys,
        cell_of(F.unix_micros("updated_at")).alias("cell"),
        F.unix_micros("updated_at").alias("at"),
        F.lit(0).alias("is_probe"),
        F.lit(None).cast("string").alias("probe_id"),
        F.lit(None).cast("bigint").alias("ack_us"),
    ).distinct()
    # Latest first; at equal times the raise comes before the probe and is seen by it.
    backwards = (
        Window.partitionBy(*keys, "cell")
        .orderBy(F.desc("at"), "is_probe")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    next_raise = F.last(F.when(F.col("is_probe") == 0, F.col("at")), ignorenulls=True)
    seen = (
        looking.withColumn("probe_id", F.col("probe_id").cast("string"))
        .unionByName(raising)
        .withColumn("visible_us", next_raise.over(backwards))
        .where(F.col("is_probe") == 1)
        .groupBy(*keys, "probe_id")
        .agg(F.min("visible_us").alias("visible_us"), F.max("ack_us").alias("ack_us"))
    )
    waited = F.greatest(F.lit(0), F.floor((F.col("visible_us") - F.col("ack_us")) / 1000))
    in_time = F.col("visible_us") <= F.col("ack_us") + F.lit(timeout_ms * 1000)
    return seen.select(
        *keys,
        "probe_id",
        F.when(in_time, waited.cast("bigint")).alias("latency_ms"),
        F.coalesce(~in_time, F.lit(True)).alias("timed_out"),
    )


def expected_values(samples: DataFrame, *keys: str) -> DataFrame:
    """What the total, error rate and mean latency of request samples must come to.

    Missing parts take the sample defaults: one request, status 200, 100 ms.
    """
    count = F.coalesce("count", F.lit(1))
    status = F.coalesce("status_code", F.lit(200))
    latency = F.coalesce("latency_ms", F.lit(100))
    total = F.sum(count)

    def share(part: Column) -> Column:
        return F.when(total == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.sum(part).cast("double"), total)
        )

    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events_produced"),
        total.alias("expected_total"),
        share(F.when(status >= 500, count).otherwise(0)).alias("expected_error_rate"),
        share(count * latency).alias("expected_average_latency_ms"),
    )


def raw_rows(rows: DataFrame, order_by: Sequence[str], limit: int) -> DataFrame:
    return rows.orderBy(*order_by).limit(limit)
