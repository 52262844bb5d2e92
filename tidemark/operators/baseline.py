"""The built-in features recomputed from history: an independent second path.

History is reduced to sums of five minutes per entity, the two of a ten-minute window in one row, so
that all windows come from one shuffle; totals are sums of their own.

Windows asked for by any start, aligned or not, are differences of running sums: the sums of all
events of an entity before an instant are read at the two ends of a window, as of its start and as
of its end. One ordered pass over ten-minute cells serves any number of lookups of an entity, each
event and each lookup being passed once; no event ever meets a lookup in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import tumbling_start
from tidemark.operators.serving import (
    STALE_AFTER_MS,
    _with_active_version,
    freshness_ms,
)
from tidemark.plans.features import ENTITY_KEYS

FIVE_MINUTES = 300_000
TEN_MINUTES = 600_000

TOTAL = "request_count_total"
EVENT_COUNT = "entity_event_count_10m"
ERROR_RATE = "entity_error_rate_10m"
LATENCY = "entity_avg_latency_ms_5m"

# Window length of each feature; the total has none.
WINDOW_MS = {EVENT_COUNT: TEN_MINUTES, ERROR_RATE: TEN_MINUTES, LATENCY: FIVE_MINUTES}

_SUMS = ("events", "requests", "errors", "latency")


def _values() -> dict[str, Column]:
    """What one event adds to the sums."""
    failed = F.col("status_code") >= 500
    return {
        "events": F.lit(1).cast("bigint"),
        "requests": F.col("count_value"),
        "errors": F.when(failed, F.col("count_value")).otherwise(0),
        "latency": F.col("latency_ms") * F.col("count_value"),
    }


def _event_values() -> list[Column]:
    return [*[v.alias(n) for n, v in _values().items()], F.col("event_time").alias("updated_at")]


def _event_sums() -> list[Column]:
    sums = [F.sum(v).alias(n) for n, v in _values().items()]
    return [*sums, F.max("event_time").alias("updated_at")]


def _roll_up(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.max("updated_at").alias("updated_at")
    )


def _per_request(total: str) -> Column:
    return F.when(F.col("requests") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col(total).cast("double"), F.col("requests").cast("double"))
    )


def feature_value(feature: str) -> Column:
    return {
        TOTAL: F.col("requests").cast("double"),
        EVENT_COUNT: F.col("events").cast("double"),
        ERROR_RATE: _per_request("errors"),
        LATENCY: _per_request("latency"),
    }[feature]


def five_minute_sums(history: DataFrame) -> DataFrame:
    start = tumbling_start(F.col("event_time"), FIVE_MINUTES)
    return history.groupBy(*ENTITY_KEYS, start.alias("window_start")).agg(*_event_sums())


def window_sums(history: DataFrame, size_ms: int) -> DataFrame:
    sums = five_minute_sums(history)
    if size_ms == FIVE_MINUTES:
        return sums
    coarser = sums.withColumn("window_start", tumbling_start(F.col("window_start"), size_ms))
    return _roll_up(coarser, *ENTITY_KEYS, "window_start")


def _feature_columns(feature: str, window_start: Column) -> list[Column]:
    return [
        *[F.col(c) for c in ENTITY_KEYS],
        F.lit(feature).alias("feature_name"),
        window_start.alias("window_start"),
        feature_value(feature).alias("value"),
        F.col("updated_at"),
    ]


def totals(history: DataFrame) -> DataFrame:
    sums = history.groupBy(*ENTITY_KEYS).agg(*_event_sums())
    return sums.select(*_feature_columns(TOTAL, F.lit(None).cast("timestamp")))


def windows(history: DataFrame, feature: str) -> DataFrame:
    """Every window of one feature."""
    sums = window_sums(history, WINDOW_MS[feature])
    return sums.select(*_feature_columns(feature, F.col("window_start")))


def _levels(start: Column) -> Column:
    """The total, the five-minute and the ten-minute window that a five-minute row feeds."""
    return F.array(
        F.struct(F.lit(0).alias("size_ms"), F.lit(None).cast("timestamp").alias("start")),
        F.struct(F.lit(FIVE_MINUTES).alias("size_ms"), start.alias("start")),
        F.struct(
            F.lit(TEN_MINUTES).alias("size_ms"), tumbling_start(start, TEN_MINUTES).alias("start")
        ),
    )


def _features_of_size() -> Column:
    """The features whose value the sums of one ``size_ms`` give; others are null."""

    def of(size_ms: int, feature: str) -> Column:
        return F.when(
            F.col("size_ms") == size_ms,
            F.struct(F.lit(feature).alias("feature_name"), feature_value(feature).alias("value")),
        )

    return F.array(of(0, TOTAL), *[of(size, name) for name, size in WINDOW_MS.items()])


def _half_sums(history: DataFrame) -> DataFrame:
    """Per entity and ten minutes the sums of the first and of the second five, null where no event is."""
    ten = tumbling_start(F.col("event_time"), TEN_MINUTES)
    second = F.coalesce(tumbling_start(F.col("event_time"), FIVE_MINUTES) != ten, F.lit(False))
    values = {**_values(), "updated_at": F.col("event_time")}
    sums = []
    for half, hit in enumerate((~second, second)):
        for name, value in values.items():
            reduce = F.max if name == "updated_at" else F.sum
            sums.append(reduce(F.when(hit, value)).alias(f"{name}{half}"))
    return history.groupBy(*ENTITY_KEYS, ten.alias("window_start")).agg(*sums)


def all_windows(history: DataFrame) -> DataFrame:
    """Every window of every feature and the totals.

    A row of ten minutes gives its two five-minute windows and its own where it lies, so nothing but
    those rows is shuffled. Totals, reduced before the shuffle, read the history once more.
    """
    start, length = F.col("window_start"), F.lit(FIVE_MINUTES)
    second = F.timestamp_micros(F.unix_micros(start) + length * F.lit(1000).cast("bigint"))

    def half(number: int, begin: Column) -> Column:
        values = [F.col(f"{c}{number}").alias(c) for c in (*_SUMS, "updated_at")]
        row = F.struct(F.lit(FIVE_MINUTES).alias("size_ms"), begin.alias("start"), *values)
        return F.when(F.col(f"events{number}").isNotNull(), row)

    def both(name: str) -> Column:
        first, last = F.col(f"{name}0"), F.col(f"{name}1")
        return F.coalesce(first + last, first, last).alias(name)

    whole = F.struct(
        F.lit(TEN_MINUTES).alias("size_ms"),
        start.alias("start"),
        *[both(c) for c in _SUMS],
        F.greatest("updated_at0", "updated_at1").alias("updated_at"),
    )
    found = F.explode(F.array(half(0, start), half(1, second), whole)).alias("w")
    sums = _half_sums(history).select(*ENTITY_KEYS, found).where(F.col("w").isNotNull()).select(*ENTITY_KEYS, "w.*")
    rows = (
        sums.select(
            *ENTITY_KEYS,
            F.col("start").alias("window_start"),
            "updated_at",
            F.explode(_features_of_size()).alias("f"),
        )
        .where(F.col("f").isNotNull())
        .select(*ENTITY_KEYS, "f.feature_name", "window_start", "f.value", "updated_at")
    )
    return rows.unionByName(totals(history))


def latest(rows: DataFrame) -> DataFrame:
    """The newest window per (entity, feature); totals stay as they are."""
    order = F.coalesce(F.unix_millis("window_start"), F.lit(-(2**62)))
    return rows.groupBy(*ENTITY_KEYS, "feature_name").agg(
        *[F.max_by(c, order).alias(c) for c in ("window_start", "value", "updated_at")]
    )


# As long as the longest window: a window lies in one cell or in two.
_CELL_US = TEN_MINUTES * 1000


def _bounds(asked: DataFrame) -> DataFrame:
    """The reads an asked window (entity, ``start``, ``size_ms``) takes: (cell, instant, sign).

    Sums run from the beginning of each cell. A window that ends in the cell after its own takes
    what its own cell holds from its start on, and what the next holds up to its end.
    """
    begin = F.unix_micros("start")
    end = begin + F.col("size_ms").cast("bigint") * 1000
    cell = F.floor(begin / F.lit(_CELL_US))
    cell_end = (cell + 1) * F.lit(_CELL_US)

    def read(where: Column, at: Column, sign: int) -> Column:
        return F.struct(where.alias("cell"), at.alias("at"), F.lit(sign).alias("sign"))

    reads = F.array(
        read(cell, begin, -1),
        read(cell, F.least(end, cell_end), 1),
        F.when(end > cell_end, read(cell + 1, end, 1)),
    )
    found = asked.select(*ENTITY_KEYS, "start", "size_ms", F.explode(reads).alias("r"))
    return found.where(F.col("r").isNotNull()).select(*ENTITY_KEYS, "start", "size_ms", "r.*")


def _recomputed(history: DataFrame, asked: DataFrame, with_latest: bool) -> DataFrame:
    """Sums of the asked windows (``is_asked``), and of all windows if ``with_latest``.

    Columns: entity, ``size_ms``, ``start``, ``is_asked``, the sums and ``updated_at``. The
    history is scanned once: its rows are reduced to five-minute sums and, between the first and the
    last instant asked for, to sums per instant, in one aggregate.
    """
    bounds = _bounds(asked)
    # A few instants per entity prune more cheaply than all asked cells would.
    spans = bounds.groupBy(*ENTITY_KEYS).agg(F.min("at").alias("from_us"), F.max("at").alias("to_us"))
    at = F.unix_micros("event_time")
    within = (at >= F.col("from_us")) & (at < F.col("to_us"))
    located = history.join(spans, ENTITY_KEYS, "left" if with_latest else "inner").select(
        *[F.col(c) for c in history.columns],
        F.floor(at / F.lit(_CELL_US)).alias("cell"),
        F.coalesce(within, F.lit(False)).alias("is_asked"),
    )
    if not with_latest:
        located = located.where(F.col("is_asked"))
    five = F.unix_micros(tumbling_start(F.col("event_time"), FIVE_MINUTES))
    nothing = F.lit(None).cast("bigint")

    def role(cell: Column, instant: Column) -> Column:
        return F.struct(cell.alias("cell"), instant.alias("at"))

    values = [*_SUMS, "updated_at"]
    if with_latest:
        # Without a cell: a five-minute row for the aligned windows, not for the ordered pass.
        roles = F.array(F.when(F.col("is_asked"), role(F.col("cell"), at)), role(nothing, five))
        moments = (
            located.select("*", F.explode(roles).alias("role"))
            .where(F.col("role").isNotNull())
            .groupBy(*ENTITY_KEYS, "role")
            .agg(*_event_sums())
            .select(*ENTITY_KEYS, "role.*", *values)
        )
    else:
        moments = located.select(*ENTITY_KEYS, "cell", at.alias("at"), *_event_values())
    kinds = {f.name: f.dataType for f in moments.schema if f.name in values}
    events = moments.select(
        *ENTITY_KEYS,
        "cell",
        "at",
        F.lit(1).alias("kind"),
        *values,
        F.lit(None).cast("timestamp").alias("start"),
        F.lit(None).cast("int").alias("size_ms"),
        F.lit(None).cast("int").alias("sign"),
    )
    reads = bounds.select(
        *ENTITY_KEYS,
        "cell",
        "at",
        F.lit(0).alias("kind"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in values],
        "start",
        F.col("size_ms").cast("int").alias("size_ms"),
        "sign",
    )
    group = [*ENTITY_KEYS, "cell"]
    if with_latest:
        # A five-minute row is a group of its own.
        group.append(F.when(F.col("cell").isNull(), F.col("at")))
    so_far = Window.partitionBy(*group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    running = events.unionByName(reads).select(
        *ENTITY_KEYS,
        "cell",
        "at",
        "start",
        "size_ms",
        "sign",
        *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in _SUMS],
        F.max("updated_at").over(so_far).alias("updated_at"),
    )
    sign, is_read = F.col("sign"), F.col("sign").isNotNull()
    # Of the newest event before the end of the window only counts what is not before its start.
    newest = F.when((sign > 0) & (F.col("updated_at") >= F.col("start")), F.col("updated_at"))
    answered = F.array(
        F.struct(
            "size_ms",
            "start",
            F.lit(True).alias("is_asked"),
            *[(F.col(c) * sign).alias(c) for c in _SUMS],
            newest.alias("updated_at"),
        )
    )
    aligned = F.transform(
        _levels(F.timestamp_micros("at")),
        lambda level: F.struct(
            level["size_ms"].alias("size_ms"),
            level["start"].alias("start"),
            F.lit(False).alias("is_asked"),
            *[F.col(c) for c in _SUMS],
            F.col("updated_at"),
        ),
    )
    fed = running.select(
        *ENTITY_KEYS,
        F.explode(F.when(is_read, answered).when(F.col("cell").isNull(), aligned)).alias("w"),
    ).select(*ENTITY_KEYS, "w.*")
    return _roll_up(fed, *ENTITY_KEYS, "size_ms", "start", "is_asked").where(F.col("events") > 0)


def _asked(lookups: DataFrame, *features: str) -> DataFrame:
    """The distinct windows that lookups of these features name."""
    size = F.coalesce(*[F.when(F.col("feature_name") == f, F.lit(WINDOW_MS[f])) for f in features])
    return (
        lookups.where(F.col("window_start").isNotNull())
        .select(*ENTITY_KEYS, F.col("window_start").alias("start"), size.alias("size_ms"))
        .where(F.col("size_ms").isNotNull())
        .distinct()
    )


def specific_windows(history: DataFrame, lookups: DataFrame, feature: str) -> DataFrame:
    """Values of ``[window_start, window_start + size)`` for the asked starts, aligned or not.

    Every lookup counts, whatever feature it may name.
    """
    asked = _asked(lookups.withColumn("feature_name", F.lit(feature)), feature)
    sums = _recomputed(history, asked, with_latest=False)
    return sums.select(*_feature_columns(feature, F.col("start")))


def read_baseline(
    lookups: DataFrame,
    history: DataFrame,
    now: Column,
    *,
    registry: DataFrame | None = None,
    stale_ms: int = STALE_AFTER_MS,
) -> DataFrame:
    """One row per lookup, in the shape of a feature read; there is no TTL.

    Latest reads report the window they found; the total has no windows, so asking it for
    one finds nothing.
    """
    wanted = lookups.select(*ENTITY_KEYS).distinct()
    sums = _recomputed(history.join(wanted, ENTITY_KEYS, "left_semi"), _asked(lookups, *WINDOW_MS), True)
    rows = (
        sums.select("*", F.explode(_features_of_size()).alias("f"))
        .where(F.col("f").isNotNull())
        .select(
            *ENTITY_KEYS,
            "f.*",
            "start",
            F.when(F.col("is_asked"), F.col("start")).alias("asked_start"),
            "updated_at",
        )
    )
    # An asked window is alone under its start; of the others the newest is read.
    order = F.coalesce(F.unix_millis("start"), F.lit(-(2**62)))
    found = rows.groupBy(*ENTITY_KEYS, "feature_name", "asked_start").agg(
        F.max_by("start", order).alias("found_start"),
        F.max_by("value", order).alias("value"),
        F.max_by("updated_at", order).alias("updated_at"),
    )
    keys = [*ENTITY_KEYS, "feature_name"]
    right = found.select(
        *[F.col(c).alias(f"b_{c}") for c in [*keys, "asked_start"]],
        "found_start",
        "value",
        "updated_at",
    )
    on = F.col("window_start").eqNullSafe(F.col("b_asked_start"))
    for c in keys:
        on = on & (F.col(c) == F.col(f"b_{c}"))
    is_stale = F.unix_micros("updated_at") + F.lit(stale_ms * 1000) < F.unix_micros(now)
    status = (
        F.when(F.col("value").isNull(), "MISSING").when(is_stale, "STALE").otherwise("PRESENT")
    )
    return (
        _with_active_version(lookups, registry)
        .join(right, on, "left")
        .select(
            *[c for c in lookups.columns if c != "window_start"],
            F.coalesce("window_start", "found_start").alias("window_start"),
            "value",
            status.alias("status"),
            "updated_at",
            freshness_ms(F.col("updated_at"), now).alias("freshness_ms"),
            F.col("active_version").alias("definition_version"),
        )
    )


def report(history: DataFrame, feature: str, limit: int = 10) -> DataFrame:
    """Newest windows first, then entity; the first ``limit`` rows."""
    if feature == TOTAL:
        return totals(history).orderBy("entity_id", "entity_type").limit(limit)
    rows = windows(history, feature)
    return rows.orderBy(F.desc("window_start"), "entity_id", "entity_type").limit(limit)
