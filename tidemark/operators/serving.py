"""Readable views of feature rows, and lookups against them.

A serving table holds one row per key text: one per live window, and one *latest* row per
(entity, feature) with a null window start. Reads are left joins of a lookup table.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import ANY_ENTITY, FeatureDefinition
from tidemark.functions.keys import feature_key
from tidemark.functions.values import parse_value, value_text
from tidemark.functions.windows import add_millis, window_expiry
from tidemark.plans.features import ENTITY_KEYS, active_only, compute_features

STALE_AFTER_MS = 5 * 60_000
READ_KEYS = ["entity_type", "entity_id", "feature_name"]


def current_versions(
    features: DataFrame, definitions: Sequence[FeatureDefinition]
) -> DataFrame:
    """Rows of the active version of each declared feature."""
    wanted = [
        F.struct(F.lit(d.name).alias("n"), F.lit(d.version).alias("v"))
        for d in active_only(definitions)
    ]
    identity = F.struct(
        F.col("feature_name").alias("n"), F.col("definition_version").alias("v")
    )
    return features.where(identity.isin(wanted))


def latest_rows(features: DataFrame) -> DataFrame:
    """Per (entity, feature): the row of the greatest window start.

    Corrections of older windows leave it alone; corrections of that window show in it.
    """
    order = F.coalesce(F.unix_millis("window_start"), F.lit(-(2**62)))
    picked = [c for c in features.columns if c not in READ_KEYS]
    return features.groupBy(*READ_KEYS).agg(
        *[F.max_by(c, order).alias(c) for c in picked]
    )


def _integral(definitions: Sequence[FeatureDefinition]) -> Column:
    names = [d.name for d in definitions if d.aggregation not in ("AVG", "RATIO")]
    return F.col("feature_name").isin(names) if names else F.lit(False)


def serving_rows(
    features: DataFrame,
    definitions: Sequence[FeatureDefinition],
    *,
    latest: Collection[str] | None = None,
    windows: Collection[str] | None = None,
) -> DataFrame:
    """Feature rows -> serving table: windows that expire, plus latest rows that do not.

    ``latest`` and ``windows`` name the features whose rows of that kind are wanted; by default all.
    """
    if latest is not None and not latest:
        return _window_rows(features, definitions)
    # Every row stands for itself and competes to be the latest: one pass, one shuffle of the
    # (already aggregated) feature rows.
    nothing = F.lit(None).cast("timestamp")
    order = F.coalesce(F.unix_millis("window_start"), F.lit(-(2**62)))
    itself = F.when(
        F.col("window_start").isNotNull(),
        F.struct(F.col("window_start").alias("slot"), F.col("expires_at").alias("expiry")),
    )
    newest = F.struct(nothing.alias("slot"), nothing.alias("expiry"))
    if windows is not None:
        itself = F.when(F.col("feature_name").isin(sorted(windows)), itself)
    if latest is not None:
        newest = F.when(F.col("feature_name").isin(sorted(latest)), newest)
    picked = ("value", "updated_at", "definition_version", "expiry")
    return (
        current_versions(features, definitions)
        .select("*", F.explode(F.array(itself, newest)).alias("stand"))
        .where(F.col("stand").isNotNull())
        .select(*READ_KEYS, "stand.*", order.alias("rank"), *picked[:3])
        .groupBy(*READ_KEYS, "slot")
        .agg(*[F.max_by(c, "rank").alias(c) for c in picked])
        .select(
            *READ_KEYS,
            F.col("slot").alias("window_start"),
            value_text(_integral(definitions), F.col("value")).alias("value_text"),
            "updated_at",
            "definition_version",
            F.col("expiry").alias("expires_at"),
        )
    )


def _window_rows(features: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """The windows of a serving table alone: feature rows as they are."""
    windowed = current_versions(features, definitions).where(F.col("window_start").isNotNull())
    return windowed.select(
        *READ_KEYS,
        "window_start",
        value_text(_integral(definitions), F.col("value")).alias("value_text"),
        "updated_at",
        "definition_version",
        "expires_at",
    )


def with_key(serving: DataFrame) -> DataFrame:
    key = feature_key(
        F.col("entity_type"), F.col("entity_id"), F.col("feature_name"), F.col("window_start")
    )
    return serving.withColumn("feature_key", key)


def republish(
    features: DataFrame, definitions: Sequence[FeatureDefinition], restored_at: Column
) -> DataFrame:
    """Rebuild the serving table from state at ``restored_at``.

    Expiry then counts from the window start; expired windows, and latest rows that would
    show one, are left out. Every row carries the restore time.
    """
    expiry = F.lit(None).cast("timestamp")
    windowed = F.lit(False)
    for d in active_only(definitions):
        if d.window_type == "NONE":
            continue
        mine = F.col("feature_name") == d.name
        windowed = windowed | mine
        expiry = F.when(
            mine, window_expiry(F.col("window_start"), d.window, d.slide)
        ).otherwise(expiry)
    # The latest row shows the newest window; if that one is expired so are all older ones.
    alive = current_versions(features, definitions).withColumn("expires_at", expiry).where(
        ~windowed | (F.col("expires_at") > restored_at)
    )
    return serving_rows(alive, definitions).withColumn("updated_at", restored_at)


def active_versions(registry: DataFrame) -> DataFrame:
    """Registry table -> (feature_name, scope, active_version); one active row per name."""
    return registry.where(F.col("state") == "ACTIVE").select(
        F.col("name").alias("feature_name"),
        F.col("entity_type").alias("scope"),
        F.col("version").alias("active_version"),
    )


def read_status(
    value_text: Column, updated_at: Column, now: Column, stale_ms: int = STALE_AFTER_MS
) -> Column:
    """MISSING without a value, UNAVAILABLE if unreadable, STALE if too old, else PRESENT."""
    return (
        F.when(value_text.isNull(), "MISSING")
        .when(parse_value(value_text).isNull(), "UNAVAILABLE")
        .when(add_millis(updated_at, stale_ms) < now, "STALE")
        .otherwise("PRESENT")
    )


def freshness_ms(updated_at: Column, now: Column) -> Column:
    micros = F.unix_micros(now) - F.unix_micros(updated_at)
    return F.floor(micros / 1000).cast("bigint")


def ttl_seconds(expires_at: Column, now: Column) -> Column:
    left = (F.unix_micros(expires_at) - F.unix_micros(now)) / 1_000_000
    return F.when(left > 0, F.floor(left).cast("bigint"))


def _with_active_version(lookups: DataFrame, registry: DataFrame | None) -> DataFrame:
    if registry is None:
        return lookups.withColumn("active_version", F.lit(None).cast("int"))
    # One row per name, whatever the registry holds: the lowest active version of each scope.
    by_scope = (
        active_versions(registry)
        .groupBy("feature_name", "scope")
        .agg(F.min("active_version").alias("version"))
        .groupBy("feature_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("scope", "version"))).alias("by_scope"))
    )
    version = F.least(F.col("by_scope")[F.col("entity_type")], F.col("by_scope")[ANY_ENTITY])
    return (
        lookups.join(by_scope, "feature_name", "left")
        .withColumn("active_version", version)
        .drop("by_scope")
    )


def read_features(
    lookups: DataFrame,
    serving: DataFrame,
    now: Column,
    *,
    registry: DataFrame | None = None,
    stale_ms: int = STALE_AFTER_MS,
) -> DataFrame:
    """One row per lookup, also when nothing is stored for it.

    ``lookups`` has the read keys and a nullable ``window_start``; null asks for the latest
    value. Other lookup columns (such as a position) are kept.
    """
    stored = serving.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(
        *[F.col(c).alias(f"s_{c}") for c in [*READ_KEYS, "window_start"]],
        "value_text",
        F.col("updated_at").alias("s_updated_at"),
        "definition_version",
        "expires_at",
    )
    asked = _with_active_version(lookups, registry)
    on = F.lit(True)
    for c in READ_KEYS:
        on = on & (F.col(c) == F.col(f"s_{c}"))
    on = on & F.col("window_start").eqNullSafe(F.col("s_window_start"))
    joined = asked.join(stored, on, "left")

    status = read_status(F.col("value_text"), F.col("s_updated_at"), now, stale_ms)
    readable = F.col("status") != "UNAVAILABLE"
    return joined.withColumn("status", status).select(
        *lookups.columns,
        F.when(readable, parse_value(F.col("value_text"))).alias("value"),
        F.when(readable, F.col("value_text")).alias("value_text"),
        "status",
        F.when(readable, F.col("s_updated_at")).alias("updated_at"),
        F.when(readable, freshness_ms(F.col("s_updated_at"), now)).alias("freshness_ms"),
        F.when(readable, F.coalesce("definition_version", "active_version"))
        .otherwise(F.col("active_version"))
        .alias("definition_version"),
        F.when(readable, ttl_seconds(F.col("expires_at"), now)).alias("ttl_seconds"),
    )


def read_computed(
    lookups: DataFrame,
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    now: Column,
    *,
    checked: bool = False,
    registry: DataFrame | None = None,
    stale_ms: int = STALE_AFTER_MS,
) -> DataFrame:
    """``read_features`` of what ``events`` amount to, computed for the lookups alone.

    A first job over the lookups tells which declared features they name, and whether by window or
    for the latest value (one row per declaration at most). Only these are aggregated, over events
    of the entities asked for.
    """
    by_window = F.col("window_start").isNotNull()
    names = sorted({d.name for d in active_only(definitions)})
    asked = (
        lookups.where(F.col("feature_name").isin(names))
        .groupBy("feature_name")
        .agg(F.bool_or(by_window).alias("windows"), F.bool_or(~by_window).alias("latest"))
        .collect()
    )
    entities = lookups.select(*ENTITY_KEYS).distinct()
    mine = events.join(
        entities,
        (F.col("entity.type") == F.col("entity_type")) & (F.col("entity.id") == F.col("entity_id")),
        "left_semi",
    )
    wanted = {r["feature_name"] for r in asked} or set(names[:1])
    features = compute_features(mine, definitions, checked=checked, names=wanted)
    table = serving_rows(
        features,
        [d for d in definitions if d.name in wanted],
        latest={r["feature_name"] for r in asked if r["latest"]},
        windows={r["feature_name"] for r in asked if r["windows"]},
    )
    return read_features(lookups, table, now, registry=registry, stale_ms=stale_ms)


def entity_lookups(entities: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """The same features for many entities, in request order."""
    names = F.array(*[F.lit(n) for n in feature_names])
    return entities.select(
        *ENTITY_KEYS,
        F.posexplode(names).alias("pos", "feature_name"),
        F.lit(None).cast("timestamp").alias("window_start"),
    )


def feature_vectors(reads: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """Reads -> one row per entity with one column per feature."""
    return reads.groupBy(*ENTITY_KEYS).agg(
        *[F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(n)
          for n in feature_names]
    )
