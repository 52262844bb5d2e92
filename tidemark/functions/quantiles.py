"""Exact nearest-rank percentiles without gathering a group's values in one place.

Values are first counted per distinct value, on the map side too. Coarse buckets find where
a rank falls; only that bucket's distinct values are then walked in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distinct whole values per bucket, which bounds every ordered walk.
BUCKET_WIDTH = 65_536

LATENCY_PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def value_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, ``_v``, ``_c``): how often each whole value occurs, with its bucket ``_b``."""
    return (
        rows.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("bigint").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.floor(F.col("_v") / F.lit(BUCKET_WIDTH)))
    )


def ranks(
    counts: DataFrame,
    keys: Sequence[str],
    percentiles: Mapping[str, float] = LATENCY_PERCENTILES,
) -> DataFrame:
    """Nearest-rank percentiles per key from ``value_counts``.

    The two uses of ``counts`` share one shuffle: the join is null-safe, so no filter makes
    them differ, and a null key is a group like any other.
    """
    keys = list(keys)
    group = [*keys, "_all"]
    counts = counts.withColumn("_all", F.lit(0))
    in_order = Window.partitionBy(*group).orderBy("_b")
    buckets = (
        counts.groupBy(*group, "_b")
        .agg(F.sum("_c").alias("_c"))
        .select(
            *group,
            "_b",
            F.sum("_c").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
            F.sum("_c").over(Window.partitionBy(*group)).alias("_n"),
            "_c",
        )
    )
    wanted = F.array(
        *[F.struct(F.lit(n).alias("p"), _rank(p).alias("r")) for n, p in percentiles.items()]
    )
    before = F.col("_upto") - F.col("_c")
    hits = (
        buckets.withColumn("_w", F.explode(wanted))
        .where((F.col("_w.r") > before) & (F.col("_w.r") <= F.col("_upto")))
        .select(
            *[F.col(c).alias(f"_hit_{c}") for c in [*keys, "_b"]],
            F.col("_w.p").alias("_p"),
            (F.col("_w.r") - before).alias("_r"),
        )
    )
    same = F.lit(True)
    for c in [*keys, "_b"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_hit_{c}"))
    in_bucket = Window.partitionBy(*group, "_b", "_p").orderBy("_v")
    walked = counts.join(hits, same).withColumn(
        "_upto", F.sum("_c").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    )
    reached = F.col("_upto") >= F.col("_r")
    return (
        walked.groupBy(*group)
        .agg(
            *[
                F.min(F.when((F.col("_p") == name) & reached, F.col("_v"))).alias(name)
                for name in percentiles
            ]
        )
        .drop("_all")
    )


def nearest_rank(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float] = LATENCY_PERCENTILES,
) -> DataFrame:
    """One row per key with the value at position ``ceil(p * n)``; ``value`` is a whole number.

    Keys without any value have no row.
    """
    return ranks(value_counts(rows, keys, value), keys, percentiles)


def _rank(percentile: float) -> Column:
    position = F.ceil(F.lit(percentile) * F.col("_n")).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.least(position, F.col("_n")))
