"""The table of feature declarations and the operations on it.

Every operation maps a registry DataFrame to a new one; writing it back is the caller's step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.definitions import (
    AGGREGATIONS,
    BUILT_IN_FEATURES,
    FIELD_PATH,
    FILTER_OPERATORS,
    NEEDS_VALUE,
    STATES,
    WINDOW_TYPES,
    FeatureDefinition,
)
from tidemark.functions.durations import BLANKS, COMPACT, ISO, MAX_MS, UNIT_MS

IDENTITY = ["name", "version"]


def registry_table(
    spark: SparkSession, definitions: Sequence[FeatureDefinition] = BUILT_IN_FEATURES
) -> DataFrame:
    return spark.createDataFrame([d.as_row() for d in definitions], schemas.REGISTRY)


def seed(registry: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Add declarations whose (name, version) is not there yet."""
    seeds = registry_table(registry.sparkSession, definitions)
    return registry.unionByName(seeds.join(registry.select(*IDENTITY), IDENTITY, "left_anti"))


def load_active(registry: DataFrame) -> list[FeatureDefinition]:
    """Active declarations on the driver, in (name, version) order."""
    rows = registry.where(F.col("state") == "ACTIVE").orderBy(*IDENTITY)
    return [FeatureDefinition.from_row(row.asDict()) for row in rows.collect()]


def list_definitions(registry: DataFrame) -> DataFrame:
    return registry.orderBy(*IDENTITY)


def active(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("state") == "ACTIVE")


def upsert(registry: DataFrame, saves: DataFrame) -> DataFrame:
    """Apply saves in the order of their ``save_seq``.

    The last save of a (name, version) wins. An ACTIVE save turns every other version of the
    name INACTIVE; a later save of such a version sets its state anew.
    """
    columns = [c for c in registry.columns if c not in IDENTITY]
    history = registry.withColumn("save_seq", F.lit(-1).cast("bigint")).unionByName(
        saves.select(*registry.columns, F.col("save_seq").cast("bigint").alias("save_seq"))
    )
    last = history.groupBy(*IDENTITY).agg(
        F.max("save_seq").alias("save_seq"),
        F.max_by(F.struct(*columns), "save_seq").alias("saved"),
    )
    activation = (
        saves.where(F.col("state") == "ACTIVE")
        .groupBy("name")
        .agg(
            F.max(F.col("save_seq").cast("bigint")).alias("active_seq"),
            F.max_by("version", "save_seq").alias("active_version"),
        )
    )
    displaced = (F.col("active_version") != F.col("version")) & (
        F.col("active_seq") > F.col("save_seq")
    )
    return (
        last.join(activation, "name", "left")
        .select(
            *IDENTITY,
            "saved.*",
            F.when(displaced, "INACTIVE").otherwise(F.col("saved.state")).alias("new_state"),
        )
        .withColumn("state", F.col("new_state"))
        .select(*registry.columns)
    )


def save_drafts(registry: DataFrame, saves: DataFrame) -> DataFrame:
    """Saves as a client makes them: always DRAFT, so re-saving an active version demotes it."""
    return upsert(registry, saves.withColumn("state", F.lit("DRAFT")))


def activate(registry: DataFrame, targets: DataFrame) -> DataFrame:
    """Make each target (name, version) the only active version of its name.

    Targets that do not exist change nothing (see ``unknown_targets``). At most one target
    per name.
    """
    chosen = (
        targets.select(*IDENTITY)
        .join(registry.select(*IDENTITY), IDENTITY, "left_semi")
        .select("name", F.col("version").alias("target_version"))
    )
    state = (
        F.when(F.col("target_version").isNull(), F.col("state"))
        .when(F.col("target_version") == F.col("version"), "ACTIVE")
        .otherwise("INACTIVE")
    )
    return registry.join(chosen, "name", "left").withColumn("state", state).select(
        *registry.columns
    )


def deactivate(registry: DataFrame, targets: DataFrame) -> DataFrame:
    hit = targets.select(*IDENTITY).distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("hit"), "INACTIVE").otherwise(F.col("state"))
    return registry.join(hit, IDENTITY, "left").withColumn("state", state).select(
        *registry.columns
    )


def unknown_targets(registry: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(registry.select(*IDENTITY), IDENTITY, "left_anti")


def conflicts(registry: DataFrame) -> DataFrame:
    """Repeated (name, version), and names with more than one active version."""
    repeated = (
        registry.groupBy(*IDENTITY)
        .agg(F.count(F.lit(1)).alias("entries"))
        .where(F.col("entries") > 1)
        .select(F.lit("duplicate_version").alias("conflict"), *IDENTITY, "entries")
    )
    many_active = (
        active(registry)
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("entries"))
        .where(F.col("entries") > 1)
        .select(
            F.lit("many_active").alias("conflict"),
            "name",
            F.lit(None).cast("int").alias("version"),
            "entries",
        )
    )
    return repeated.unionByName(many_active)


def summary(registry: DataFrame, *keys: str) -> DataFrame:
    return registry.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "ACTIVE").alias("active"),
    )


def duration_millis(text: Column) -> Column:
    """ISO or compact duration text as milliseconds; null if it is neither, or beyond a long.

    The column form of ``tidemark.functions.durations.parse_duration``, without the check
    that it is positive.
    """
    upper = F.upper(F.trim(text, F.lit(BLANKS)))
    by_unit = F.create_map(*[F.lit(x) for unit in UNIT_MS.items() for x in unit])

    def part(pattern: str, group: int, unit: Column | str) -> Column:
        """Digits of a group times their unit; 0 where there are none, null where they are too many."""
        digits = F.regexp_extract(upper, pattern, group)
        factor = by_unit[F.lit(unit) if isinstance(unit, str) else F.lower(unit)].cast("bigint")
        return F.when(digits == "", F.lit(0)).otherwise(F.try_multiply(digits.try_cast("bigint"), factor))

    total = F.lit(0).cast("bigint")
    for group, unit in enumerate("dhms", start=2):
        total = F.try_add(total, part(f"^{ISO}$", group, unit))
    # Whole milliseconds of the fraction, with the sign of the seconds.
    fraction = F.substring(F.rpad(F.regexp_extract(upper, f"^{ISO}$", 6), 9, "0"), 1, 3).try_cast("bigint")
    backwards = F.regexp_extract(upper, f"^{ISO}$", 5).startswith("-")
    fraction = F.coalesce(F.when(backwards, -fraction).otherwise(fraction), F.lit(0))
    sign = F.when(F.regexp_extract(upper, f"^{ISO}$", 1) == "-", -1).otherwise(1)
    compact = part(f"^{COMPACT}$", 1, F.regexp_extract(upper, f"^{COMPACT}$", 2))
    return F.when(upper.rlike(f"^{COMPACT}$"), compact).when(
        upper.rlike(f"^{ISO}$") & upper.rlike(r"\d[DHMS]"),
        F.try_multiply(sign, F.try_add(total, fraction)),
    )


def invalid(registry: DataFrame) -> DataFrame:
    """Rows that could not be built as declarations, with the first reason."""

    def blank(column: str) -> Column:
        return F.col(column).isNull() | ~F.col(column).rlike(r"\S")

    def bad_path(column: str) -> Column:
        return ~blank(column) & ~F.col(column).rlike(f"^({FIELD_PATH})$")

    def outside(column: str, domain: Sequence[str]) -> Column:
        return F.col(column).isNull() | ~F.col(column).isin(*domain)

    def bad_filter(prefix: str) -> Column:
        field, op, value = (f"{prefix}_{part}" for part in ("field", "operator", "value"))
        return (
            F.when(F.col(field).isNull(), F.lit(None).cast("string"))
            .when(blank(field) | bad_path(field), f"bad_{prefix}_field")
            .when(outside(op, FILTER_OPERATORS), f"unknown_{prefix}_operator")
            .when((F.col(op) != "EXISTS") & blank(value), f"blank_{prefix}_value")
        )

    size, slide = duration_millis(F.col("window_size")), duration_millis(F.col("slide"))
    unwindowed = F.col("window_type") == "NONE"
    reason = F.coalesce(
        F.when(blank("name"), "blank_name"),
        F.when(F.col("name").contains(":"), "bad_name"),
        F.when(blank("event_type"), "blank_event_type"),
        F.when(blank("entity_type"), "blank_entity_type"),
        F.when(outside("aggregation_type", AGGREGATIONS), "unknown_aggregation"),
        F.when(outside("window_type", WINDOW_TYPES), "unknown_window_type"),
        F.when(outside("state", STATES), "unknown_state"),
        F.when(F.col("version").isNull() | (F.col("version") < 1), "bad_version"),
        F.when(
            F.col("aggregation_type").isin(*NEEDS_VALUE) & blank("value_field"),
            "missing_value_field",
        ),
        F.when(bad_path("value_field"), "bad_value_field"),
        F.when(bad_path("weight_field"), "bad_weight_field"),
        bad_filter("filter"),
        bad_filter("numerator_filter"),
        F.when(
            (F.col("aggregation_type") == "RATIO") & F.col("numerator_filter_field").isNull(),
            "missing_numerator_filter",
        ),
        F.when(
            unwindowed & (F.col("window_size").isNotNull() | F.col("slide").isNotNull()),
            "unexpected_window",
        ),
        F.when(~unwindowed & (size.isNull() | (size <= 0)), "bad_window_size"),
        F.when(
            ~unwindowed & F.col("slide").isNotNull() & (slide.isNull() | (slide <= 0)),
            "bad_slide",
        ),
        F.when((F.col("window_type") == "SLIDING") & (slide > size), "slide_too_long"),
        # A value expires a window and a slide after it was written.
        F.when(
            ~unwindowed & (F.coalesce(F.try_add(size, F.coalesce(slide, size)), F.lit(MAX_MS + 1)) > MAX_MS),
            "window_too_long",
        ),
    )
    return registry.withColumn("reason", reason).where(F.col("reason").isNotNull())
