"""Realtime values against the recomputed baseline, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6
KEYS = ["entity_type", "entity_id", "feature_name", "window_start"]


# What a read may report.
STATUSES = ("PRESENT", "MISSING", "STALE", "UNAVAILABLE")


def _side(rows: DataFrame, name: str) -> DataFrame:
    status = (
        F.col("status")
        if "status" in rows.columns
        else F.when(F.col("value").isNotNull(), "PRESENT").otherwise("MISSING")
    )
    # Without a status: a row all the same.
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(-1).cast("bigint"))
    empty = {"realtime": "baseline", "baseline": "realtime"}[name]
    return rows.select(
        *KEYS,
        F.col("value").alias(f"{name}_value"),
        code.alias(f"{name}_code"),
        F.lit(None).cast("double").alias(f"{empty}_value"),
        F.lit(None).cast("bigint").alias(f"{empty}_code"),
    )


def _paired(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of both sides brought together by key.

    Values of the named features travel as columns of one row per (entity, window start), reduced
    before they move; all other features have rows of their own.
    """
    measures = [f"{side}_{what}" for side in ("realtime", "baseline") for what in ("value", "code")]
    if not features:
        return rows.groupBy(*KEYS).agg(*[F.max(m).alias(m) for m in measures])
    name = F.col("feature_name")
    named = F.coalesce(name.isin(*features), F.lit(False))
    slots = [(F.lit(f), F.coalesce(name == f, F.lit(False))) for f in features] + [(F.col("other"), ~named)]
    wide = rows.groupBy("entity_type", "entity_id", "window_start", F.when(~named, name).alias("other")).agg(
        *[F.max(F.when(hit, F.col(m))).alias(f"{m}{i}") for i, (_, hit) in enumerate(slots) for m in measures]
    )
    found = [
        F.when(
            F.col(f"realtime_code{i}").isNotNull() | F.col(f"baseline_code{i}").isNotNull(),
            F.struct(label.alias("feature_name"), *[F.col(f"{m}{i}").alias(m) for m in measures]),
        )
        for i, (label, _) in enumerate(slots)
    ]
    long = wide.select("entity_type", "entity_id", "window_start", F.explode(F.array(*found)).alias("f"))
    return long.where(F.col("f").isNotNull()).select("entity_type", "entity_id", "f.feature_name", "window_start", *[f"f.{m}" for m in measures])


def compare(realtime: DataFrame, baseline: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """One row per key on either side, with ``verdict``.

    Each side has a key at most once, so pairing them is a hash aggregate over the union: no
    sort, and null window starts pair like any other. ``features`` names those expected, so that
    fewer rows move; others are compared all the same.
    """
    sides = ("realtime", "baseline")
    paired = _paired(_side(realtime, "realtime").unionByName(_side(baseline, "baseline")), features)
    names = F.array(*[F.lit(s) for s in STATUSES])
    present = F.lit(STATUSES.index("PRESENT") + 1)

    def usable(side: str) -> Column:
        return F.coalesce(
            (F.col(f"{side}_code") == present) & F.col(f"{side}_value").isNotNull(),
            F.lit(False),
        )

    def status(side: str) -> Column:
        known = F.try_element_at(names, F.col(f"{side}_code").cast("int"))
        return F.when(F.coalesce(F.col(f"{side}_code"), F.lit(-1)) < 0, "MISSING").otherwise(known)

    close = F.abs(F.col("realtime_value") - F.col("baseline_value")) <= F.lit(TOLERANCE)
    verdict = (
        F.when(~usable("baseline") | ~usable("realtime"), "unavailable")
        .when(close, "match")
        .otherwise("mismatch")
    )
    return paired.select(
        *KEYS,
        "realtime_value",
        "baseline_value",
        *[status(s).alias(f"{s}_status") for s in sides],
        verdict.alias("verdict"),
    )


def summary(compared: DataFrame, *keys: str) -> DataFrame:
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("verdict") == "match").alias("matches"),
        F.count_if(F.col("verdict") == "mismatch").alias("mismatches"),
        F.count_if(F.col("verdict") == "unavailable").alias("unavailable"),
    )


def examples(compared: DataFrame, limit: int = 10) -> DataFrame:
    """The first mismatches in key order."""
    return (
        compared.where(F.col("verdict") == "mismatch")
        .orderBy("feature_name", "entity_type", "entity_id", "window_start")
        .limit(limit)
    )
