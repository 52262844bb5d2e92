"""One query per operator, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.definitions import BUILT_IN_FEATURES, REQUEST_COMPLETED, FieldFilter
from tidemark.functions.fields import resolve, resolver
from tidemark.functions.filters import compile_filter
from tidemark.functions.keys import feature_key, key_problem, parse_key
from tidemark.functions.values import number_text, parse_value
from tidemark.functions.windows import (
    add_millis,
    newest_sliding_start,
    sliding_starts,
    tumbling_start,
)
from tidemark.operators import baseline, dedup, measurements, monitoring, parity, serving
from tidemark.operators.checks import ingestion_lag_ms, timing, with_problem
from tidemark.operators.outcomes import accepted, event_outcomes, reject_late
from tidemark.plans.declared import compute_declared, match_declared
from tidemark.plans.features import (
    compute_features,
    distinct_sketches,
    finish,
    finish_sketches,
    match_definitions,
    merge_partials,
    merge_sketches,
    partials,
    with_failure,
)
from tidemark.session import prepare
from tidemark.sources import history as history_source
from tidemark.sources import registry as registry_source
from tidemark.sources.events import decode_events, encode_events, normalize_payload
from tidemark.workload import views
from tidemark.workload.views import (
    EVENTS_NOW,
    HOUR,
    MINUTE,
    REQUESTS_NOW,
    USER_FEATURES,
    feature,
    instant,
    tidy,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(function(prepare(spark), sf_dir))

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


FEATURE_COLUMNS = ["entity_type", "entity_id", "feature_name", "window_start", "value"]


def _features(spark, sf_dir, *names: str) -> DataFrame:
    """Features of all user events, in the columns the checks compare."""
    definitions = [feature(n) for n in names]
    rows = compute_features(views.user_events(spark, sf_dir), definitions)
    return rows.select(*FEATURE_COLUMNS)


# --- sources, sinks, decoding -------------------------------------------------------------


@query
def decode_events_query(spark, sf_dir):
    """JSON messages to events, with a reason for every message that is none."""
    rows = decode_events(views.messages(spark, sf_dir))
    good = F.col("problem").isNull()
    return rows.select(
        "seq",
        F.when(good, F.col("event_id")).alias("event_id"),
        F.when(good, F.col("event_type")).alias("event_type"),
        F.when(good, F.col("event_time")).alias("event_time"),
        F.when(good, F.col("entity.id")).alias("entity_id"),
        F.when(good, F.try_variant_get("payload", "$.k", "bigint")).alias("k"),
        F.when(good, F.try_variant_get("payload", "$.count", "bigint")).alias("count"),
        "problem",
    )


QUERIES["decode_events"] = QUERIES.pop("decode_events_query")


@query
def normalize_payload_query(spark, sf_dir):
    """Whole payload numbers of request.completed, on JSON payloads."""
    events = views.user_events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", REQUEST_COMPLETED).otherwise(F.col("event_type"))
    payload = F.parse_json(
        F.to_json(
            F.struct(
                F.col("payload.value").alias("count"),
                F.col("payload.value").alias("other"),
                F.lit("7.9").alias("latencyMs"),
            )
        )
    )
    done = events.select(
        "event_id", kind.alias("event_type"), normalize_payload(kind, payload).alias("payload")
    )
    return done.select(
        "event_id",
        "event_type",
        F.variant_get("payload", "$.count", "double").alias("count"),
        F.variant_get("payload", "$.other", "double").alias("other"),
        F.variant_get("payload", "$.latencyMs", "string").alias("latency_text"),
    )


QUERIES["normalize_payload"] = QUERIES.pop("normalize_payload_query")


@query
def encode_events_query(spark, sf_dir):
    events = views.user_events(spark, sf_dir).withColumn(
        "payload", F.struct("payload.k", F.col("event_type").alias("kind"))
    )
    return events.select("event_id", encode_events(events).alias("json"))


QUERIES["encode_events"] = QUERIES.pop("encode_events_query")


@query
def history_append(spark, sf_dir):
    """Request log appended to a history that already holds some of its ids."""
    stored = (
        views.table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("event_id"))
    )
    batch = views.request_history(spark, sf_dir)
    order = ["event_time", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return history_source.new_rows(batch, stored, order).select(
        "event_id", "entity_id", "event_time", "count_value", "status_code", "latency_ms"
    )


@query
def history_scan(spark, sf_dir):
    rows = history_source.scan_history(
        views.request_history(spark, sf_dir),
        event_type=REQUEST_COMPLETED,
        entity_type="service",
        run_id="run-1",
    )
    return rows.select(
        "event_id", "entity_id", "event_time", "count_value", "status_code", "latency_ms"
    )


@query
def materialize_rows(spark, sf_dir):
    """Feature rows of on-time events as readable rows: windows with expiry, latest without."""
    events = reject_late(views.user_events(spark, sf_dir))
    rows = serving.serving_rows(compute_features(events, USER_FEATURES), USER_FEATURES)
    return serving.with_key(rows).select(
        "feature_key",
        parse_value(F.col("value_text")).alias("value"),
        "updated_at",
        "definition_version",
        "expires_at",
    )


@query
def republish(spark, sf_dir):
    state = compute_features(views.user_events(spark, sf_dir), USER_FEATURES)
    rows = serving.republish(state, USER_FEATURES, instant("2024-01-30 12:00:00"))
    return serving.with_key(rows).select(
        "feature_key",
        parse_value(F.col("value_text")).alias("value"),
        "updated_at",
        "definition_version",
        "expires_at",
    )


# --- validation, projection, filters --------------------------------------------------------


def _doubtful_events(spark, sf_dir) -> DataFrame:
    """User events with request payloads, some of them wrong, some in the future."""
    events = views.user_events(spark, sf_dir)
    n, k = F.col("seq"), F.col("payload.k").cast("string")
    count = (
        F.when(n % 9 == 0, F.lit(""))
        .when(n % 9 == 1, F.lit('"count": null,'))
        .when(n % 9 == 2, F.lit('"count": "100",'))
        .when(n % 9 == 3, F.concat(F.lit('"count": -'), k, F.lit(",")))
        .when(n % 9 == 4, F.concat(F.lit('"count": -0.'), k, F.lit(",")))
        .otherwise(F.concat(F.lit('"count": '), k, F.lit(",")))
    )
    status = F.when(n % 11 == 0, F.lit('"statusCode": "ok",')).otherwise(
        F.concat(F.lit('"statusCode": '), (n % 701).cast("string"), F.lit(","))
    )
    latency = F.concat(F.lit('"latencyMs": '), (n % 31 - 2).cast("string"))
    shift = F.when(n % 10 == 7, 5 * MINUTE + 1).when(n % 10 == 8, 5 * MINUTE)
    return (
        views.variant_events(events, F.concat(F.lit("{"), count, status, latency, F.lit("}")))
        .withColumn(
            "event_type",
            F.when(F.col("event_type").isin("view", "click"), REQUEST_COMPLETED)
            .when(F.col("event_type") == "error", " ")
            .otherwise(F.col("event_type")),
        )
        .withColumn(
            "event_time",
            F.when(
                shift.isNotNull(),
                F.timestamp_micros(F.unix_micros("arrival_time") + shift * F.lit(1000)),
            ).otherwise(F.col("event_time")),
        )
    )


@query
def validate_events(spark, sf_dir):
    events = _doubtful_events(spark, sf_dir)
    return with_problem(events, F.col("arrival_time")).select("event_id", "problem")


def _nested_events(spark, sf_dir) -> DataFrame:
    """User events with a nested JSON payload; every tenth has no ``k``."""
    events = views.user_events(spark, sf_dir)
    k = F.when(F.col("seq") % 10 == 3, F.lit("null")).otherwise(
        F.col("payload.k").cast("string")
    )
    body = F.concat(
        F.lit('{"value": '), F.col("payload.value").cast("string"),
        F.lit(', "k": '), k,
        F.lit(', "device": {"os": "'), F.col("event_type"), F.lit('", "tags": [1, 2]}}'),
    )
    return views.variant_events(events, body)


@query
def field_paths(spark, sf_dir):
    events = _nested_events(spark, sf_dir)
    at = lambda path: resolve(events.schema, path)
    return events.select(
        F.col("event_id"),
        at("eventId").text.alias("id_text"),
        at("eventTime").text.alias("time_text"),
        at("entity.id").text.alias("entity_text"),
        at("payload.k").present.alias("k_present"),
        at("k").text.alias("k_text"),
        at("k").number.alias("k_number"),
        at("payload.value").number.alias("value_number"),
        at("device.os").text.alias("os_text"),
        at("device.os").is_number.alias("os_is_number"),
        at("device.tags.first").present.alias("through_list"),
        at("device.missing").present.alias("missing"),
        at("payload.payload.k").present.alias("prefixed_twice"),
    )


def _filter_query(operator: str) -> Query:
    def run(spark, sf_dir):
        nested = _nested_events(spark, sf_dir)
        flat = views.user_events(spark, sf_dir)

        def hit(events: DataFrame, path: str, literal: str):
            return compile_filter(FieldFilter(path, operator, literal), resolver(events.schema)).matches

        by_variant = nested.select(
            "event_id",
            hit(nested, "k", "50").alias("number_matches"),
            hit(nested, "device.os", "purchase").alias("text_matches"),
            hit(nested, "device.model", "x").alias("missing_matches"),
            hit(nested, "entity.id", "u-7").alias("entity_matches"),
            compile_filter(FieldFilter("k", operator, "many"), resolver(nested.schema)).unusable.alias(
                "unusable"
            ),
        )
        by_column = flat.select(
            "event_id", hit(flat, "payload.value", "100").alias("column_matches")
        )
        # Both sides have a row per event: never a table held whole by every task.
        return by_variant.join(by_column.hint("merge"), "event_id")

    run.__name__ = f"filter_{operator.lower()}"
    run.__doc__ = f"Declared {operator} filters on numbers, text and missing fields."
    return run


for _operator in ("EXISTS", "EQ", "NE", "GT", "GTE", "LT", "LTE"):
    query(_filter_query(_operator))


@query
def feature_keys(spark, sf_dir):
    events = views.user_events(spark, sf_dir)
    entity = F.when(F.col("seq") % 10 == 4, F.concat(F.col("entity.id"), F.lit(":x"))).otherwise(
        F.col("entity.id")
    )
    start = F.when(F.col("seq") % 3 > 0, tumbling_start(F.col("event_time"), 10 * MINUTE))
    name = F.lit("click_count_10m")
    return events.select(
        "event_id",
        feature_key(F.col("entity.type"), entity, name, start).alias("feature_key"),
        key_problem(F.col("entity.type"), entity, name).alias("problem"),
    )


@query
def parse_keys(spark, sf_dir):
    events = views.user_events(spark, sf_dir)
    start = F.when(F.col("seq") % 3 > 0, tumbling_start(F.col("event_time"), 10 * MINUTE))
    key = feature_key(F.lit("user"), F.col("entity.id"), F.col("event_type"), start)
    broken = (
        F.when(F.col("seq") % 10 == 4, F.concat(key, F.lit(":tail")))
        .when(F.col("seq") % 10 == 5, F.regexp_replace(key, "window", "pane"))
        .otherwise(key)
    )
    return events.select("event_id", parse_key(broken).alias("p")).select(
        "event_id", F.col("p").isNotNull().alias("is_key"), "p.*"
    )


@query
def value_text(spark, sf_dir):
    value = F.when(F.col("seq") % 2 == 0, F.floor("payload.value").cast("double")).otherwise(
        F.col("payload.value")
    )
    events = views.user_events(spark, sf_dir).withColumn("stored", number_text(value))
    return events.select("event_id", "stored", parse_value(F.col("stored")).alias("read_back"))


# --- event time, dedup, outcome --------------------------------------------------------------


@query
def lateness(spark, sf_dir):
    return views.user_events(spark, sf_dir).select(
        "event_id", timing(F.col("event_time"), F.col("arrival_time")).alias("timing")
    )


@query
def reject_late_query(spark, sf_dir):
    return reject_late(views.user_events(spark, sf_dir)).select(
        "event_id", "event_time", "arrival_time"
    )


QUERIES["reject_late"] = QUERIES.pop("reject_late_query")


@query
def dedup_first(spark, sf_dir):
    taken = dedup.first_arrivals(views.repeated_events(spark, sf_dir))
    return taken.select(
        "namespace", "event_id", F.timestamp_millis("marker_ms").alias("taken_at"), "marker_seq"
    )


@query
def dedup_retention(spark, sf_dir):
    """Arrivals taken under a 24 hour retention: an id comes back once its marker is gone."""
    taken = dedup.markers(views.redelivered_events(spark, sf_dir))
    return taken.select(
        "namespace", "event_id", F.timestamp_millis("marker_ms").alias("taken_at"), "marker_seq"
    )


@query
def live_markers(spark, sf_dir):
    taken = dedup.markers(views.redelivered_events(spark, sf_dir))
    return dedup.live_markers(taken, instant("2024-01-30 00:00:00"))


def _outcomes(spark, sf_dir) -> DataFrame:
    """Outcomes of repeated deliveries; some values are no numbers, some events invalid."""
    events = views.repeated_events(spark, sf_dir)
    n = F.col("seq") % 1_000_000_000_000
    value = (
        F.when(n % 6 == 0, F.lit('"many"'))
        .when(n % 17 == 1, F.lit("null"))
        .otherwise(F.col("payload.value").cast("string"))
    )
    body = F.concat(
        F.lit('{"value": '), value, F.lit(', "k": '), F.col("payload.k").cast("string"), F.lit("}")
    )
    events = views.variant_events(events, body).withColumn(
        "event_type", F.when(n % 23 == 2, F.lit(" ")).otherwise(F.col("event_type"))
    )
    return event_outcomes(events, USER_FEATURES)


@query
def event_outcomes_query(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "event_id", "seq", "outcome", "timing", "lag_ms", "late_accepted"
    )


QUERIES["event_outcomes"] = QUERIES.pop("event_outcomes_query")


@query
def ingestion_lag(spark, sf_dir):
    return views.user_events(spark, sf_dir).select(
        "event_id",
        ingestion_lag_ms(F.col("event_time"), F.col("arrival_time")).alias("lag_ms"),
    )


# --- declarations ---------------------------------------------------------------------------


@query
def match_definitions_query(spark, sf_dir):
    return match_definitions(views.user_events(spark, sf_dir), USER_FEATURES).select(
        "event_id", "feature_name", "definition_version"
    )


QUERIES["match_definitions"] = QUERIES.pop("match_definitions_query")


@query
def registry_list(spark, sf_dir):
    seeded = registry_source.seed(views.registry(spark, sf_dir), BUILT_IN_FEATURES)
    return registry_source.list_definitions(seeded)


@query
def registry_invalid(spark, sf_dir):
    return registry_source.invalid(views.registry(spark, sf_dir)).select(
        "name", "version", "reason"
    )


@query
def registry_upsert(spark, sf_dir):
    return registry_source.upsert(
        views.registry(spark, sf_dir), views.registry_saves(spark, sf_dir)
    ).select("name", "version", "event_type", "aggregation_type", "window_size", "state")


@query
def registry_activate(spark, sf_dir):
    return registry_source.activate(
        views.registry(spark, sf_dir), views.registry_targets(spark, sf_dir)
    ).select("name", "version", "state")


@query
def registry_deactivate(spark, sf_dir):
    return registry_source.deactivate(
        views.registry(spark, sf_dir), views.registry_targets(spark, sf_dir)
    ).select("name", "version", "state")


@query
def registry_active(spark, sf_dir):
    return registry_source.active(views.registry(spark, sf_dir)).select(
        "name", "version", "event_type", "aggregation_type", "window_type"
    )


@query
def registry_conflicts(spark, sf_dir):
    both = views.registry(spark, sf_dir).unionByName(
        views.registry_saves(spark, sf_dir).drop("save_seq")
    )
    return registry_source.conflicts(both)


@query
def registry_summary(spark, sf_dir):
    return registry_source.summary(views.registry(spark, sf_dir))


# --- windows --------------------------------------------------------------------------------


@query
def window_tumbling(spark, sf_dir):
    return views.user_events(spark, sf_dir).select(
        "event_id", tumbling_start(F.col("event_time"), 10 * MINUTE).alias("window_start")
    )


@query
def window_sliding(spark, sf_dir):
    """Ten-minute windows every four minutes: two or three per event."""
    starts = sliding_starts(F.col("event_time"), 10 * MINUTE, 4 * MINUTE)
    return views.user_events(spark, sf_dir).select(
        "event_id", F.explode(starts).alias("window_start")
    )


@query
def window_newest(spark, sf_dir):
    return views.user_events(spark, sf_dir).select(
        "event_id", newest_sliding_start(F.col("event_time"), 15 * MINUTE).alias("window_start")
    )


@query
def window_ttl(spark, sf_dir):
    now = instant("2024-01-29 12:00:00")
    rows = compute_features(
        views.user_events(spark, sf_dir),
        [feature("click_count_1h_15m"), feature("avg_value_1d")],
    )
    return rows.select(
        "entity_id",
        "feature_name",
        "window_start",
        "expires_at",
        serving.ttl_seconds(F.col("expires_at"), now).alias("ttl_seconds"),
    )


@query
def late_correction(spark, sf_dir):
    """Hourly purchase sums before and after the accepted late events arrive."""
    events = views.user_events(spark, sf_dir).withColumn(
        "timing", timing(F.col("event_time"), F.col("arrival_time"))
    )
    rows = events.where(F.col("timing") != "TOO_LATE").groupBy(
        F.col("entity.id").alias("entity_id"),
        tumbling_start(F.col("event_time"), HOUR).alias("window_start"),
    )
    on_time = F.col("timing") == "ON_TIME"
    return rows.agg(
        F.count_if(on_time).alias("on_time_events"),
        F.count(F.lit(1)).alias("events"),
        F.sum(F.when(on_time, F.col("payload.value")).otherwise(0.0)).alias("on_time_value"),
        F.sum("payload.value").alias("corrected_value"),
    )


# --- aggregations ---------------------------------------------------------------------------


def _feature_query(query_name: str, feature_name: str) -> None:
    def run(spark, sf_dir):
        return _features(spark, sf_dir, feature_name)

    run.__name__, run.__doc__ = query_name, f"The feature {feature_name} over all events."
    query(run)


for _query_name, _feature_name in (
    ("count_tumbling", "click_count_10m"),
    ("count_sliding", "click_count_1h_15m"),
    ("sum_total", "purchase_value_total"),
    ("ratio_tumbling", "big_purchase_share_1d"),
    ("avg_plain", "avg_value_1d"),
    ("avg_weighted", "avg_value_by_k_1d"),
    ("distinct_tumbling", "distinct_k_1d"),
    ("distinct_sliding", "distinct_k_6h_1h"),
):
    _feature_query(_query_name, _feature_name)


@query
def busiest_sliding(spark, sf_dir):
    """Per user the busiest of all one-day windows that start at every minute, and how many there are."""
    clicks = replace(feature("click_count_1h_15m"), name="clicks_1d_1m", window=24 * HOUR, slide=MINUTE)
    rows = compute_features(views.user_events(spark, sf_dir), [clicks])
    # By value first: sums of fixed width, so that no window is sorted.
    user = ["entity_type", "entity_id"]
    by_value = rows.groupBy(*user, "value").agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("first"), F.sum("n").alias("counted")
    )
    return by_value.groupBy(*user).agg(
        F.sum("windows").alias("windows"),
        F.max("value").alias("peak"),
        F.max_by("first", "value").alias("peak_start"),
        F.sum("counted").alias("counted"),
    )


@query
def sum_tumbling(spark, sf_dir):
    from tidemark.definitions import FeatureDefinition

    hourly = FeatureDefinition(
        "requests_1h",
        REQUEST_COMPLETED,
        "SUM",
        "service",
        value_field="count",
        window_type="TUMBLING",
        window="1h",
    )
    return compute_features(views.request_log(spark, sf_dir), [hourly]).select(*FEATURE_COLUMNS)


@query
def merge_partials_query(spark, sf_dir):
    """State of three disjoint event sets, merged: the same as one pass over all."""
    events = views.user_events(spark, sf_dir)
    first, second = instant("2024-01-10 07:07:07"), instant("2024-01-20 00:00:00")
    at = F.col("event_time")
    parts = [
        partials(events.where(span), USER_FEATURES)
        for span in (at < first, (at >= first) & (at < second), at >= second)
    ]
    return finish(merge_partials(*parts), USER_FEATURES).select(*FEATURE_COLUMNS, "n")


QUERIES["merge_partials"] = QUERIES.pop("merge_partials_query")


@query
def distinct_approx(spark, sf_dir):
    """Distinct counts by sketches of two event sets that overlap, beside the exact ones."""
    events = views.user_events(spark, sf_dir)
    asked = [feature("distinct_k_1d"), feature("distinct_k_6h_1h")]
    at = F.col("event_time")
    sides = [events.where(at < instant("2024-01-20 00:00:00")), events.where(at >= instant("2024-01-10 00:00:00"))]
    names = {d.name for d in asked}
    state = merge_sketches(*[distinct_sketches(s, USER_FEATURES, names=names) for s in sides])
    estimates = finish_sketches(state, asked).withColumnRenamed("value", "estimate")
    exact = compute_features(events, USER_FEATURES, names=names)
    off = F.abs(F.col("estimate") - F.col("value"))
    keys = ["entity_type", "entity_id", "feature_name", "window_start"]
    return estimates.select(*keys, "estimate").join(
        exact.withColumnsRenamed({k: f"exact_{k}" for k in keys}),
        F.expr(" and ".join(f"{k} <=> exact_{k}" for k in keys)),
        "full",
    ).select(
        *keys,
        F.col("value").alias("exact"),
        # Four standard errors.
        F.coalesce(off <= F.greatest(F.lit(0.5), F.lit(0.065) * F.col("value")), F.lit(False)).alias("close"),
    )


@query
def features_all(spark, sf_dir):
    """The four built-in features over the request log: one scan, one shuffle."""
    return compute_features(views.request_log(spark, sf_dir), BUILT_IN_FEATURES).select(
        *FEATURE_COLUMNS, "n", "updated_at"
    )


@query
def user_features_all(spark, sf_dir):
    """All user features, sliding and distinct ones included, in one pass."""
    return compute_features(views.user_events(spark, sf_dir), USER_FEATURES).select(
        *FEATURE_COLUMNS, "n", "updated_at", "expires_at"
    )


@query
def declared_features(spark, sf_dir):
    """A hundred filtered declarations, read from registry rows instead of compiled into the plan."""
    registry = registry_source.registry_table(spark, views.THRESHOLD_FEATURES)
    return compute_declared(views.user_events(spark, sf_dir), registry).select(*FEATURE_COLUMNS, "n")


@query
def declared_matches(spark, sf_dir):
    registry = registry_source.registry_table(spark, views.USER_FEATURES)
    return match_declared(views.user_events(spark, sf_dir), registry).select(
        "event_id", "feature_name", "definition_version"
    )


@query
def bad_values(spark, sf_dir):
    """Why a matching declaration cannot use an event."""
    events = views.user_events(spark, sf_dir)
    n = F.col("seq")
    value = F.when(n % 6 == 0, F.lit('"many"')).otherwise(F.col("payload.value").cast("string"))
    k = F.when(n % 7 == 0, F.lit("null")).otherwise(F.col("payload.k").cast("string"))
    body = F.concat(F.lit('{"value": '), value, F.lit(', "k": '), k, F.lit("}"))
    events = views.variant_events(events, body).withColumn(
        "entity",
        F.when(
            n % 25 == 0,
            F.struct(F.col("entity.type"), F.concat("entity.id", F.lit(":b")).alias("id")),
        ).otherwise(F.col("entity")),
    )
    return with_failure(events, USER_FEATURES).select("event_id", F.col("failure").alias("reason"))


# --- latest view, serving reads -----------------------------------------------------------------


@query
def latest_alias(spark, sf_dir):
    rows = compute_features(views.user_events(spark, sf_dir), USER_FEATURES)
    return serving.latest_rows(rows).select(*FEATURE_COLUMNS, "updated_at")


def _serving(spark, sf_dir) -> DataFrame:
    return serving.serving_rows(
        compute_features(views.request_log(spark, sf_dir), BUILT_IN_FEATURES), BUILT_IN_FEATURES
    )


def _registry(spark, sf_dir) -> DataFrame:
    return registry_source.seed(views.registry(spark, sf_dir), BUILT_IN_FEATURES)


@query
def read_point(spark, sf_dir):
    """For every logged request: the ten-minute event count of its window."""
    log = views.request_log(spark, sf_dir)
    lookups = log.select(
        F.col("entity.type").alias("entity_type"),
        F.col("entity.id").alias("entity_id"),
        F.lit("entity_event_count_10m").alias("feature_name"),
        tumbling_start(F.col("event_time"), 10 * MINUTE).alias("window_start"),
    ).distinct()
    # A clock inside the data: windows of later writes are still readable, older have expired.
    now = instant("1998-07-01 00:00:00")
    return serving.read_computed(lookups, log, BUILT_IN_FEATURES, now).select(
        "entity_id", "window_start", "value", "status", "ttl_seconds"
    )


SUBSET = (
    "entity_avg_latency_ms_5m",
    "unknown_feature",
    "request_count_total",
    "entity_error_rate_10m",
)


@query
def read_subset(spark, sf_dir):
    """A list of features for every supplier, in request order."""
    lookups = serving.entity_lookups(views.service_entities(spark, sf_dir), SUBSET)
    return serving.read_features(
        lookups, _serving(spark, sf_dir), instant(REQUESTS_NOW), registry=_registry(spark, sf_dir)
    ).select("entity_id", "pos", "feature_name", "value", "status", "definition_version")


@query
def feature_vector(spark, sf_dir):
    lookups = serving.entity_lookups(views.service_entities(spark, sf_dir), SUBSET)
    reads = serving.read_features(lookups, _serving(spark, sf_dir), instant(REQUESTS_NOW))
    return serving.feature_vectors(reads, SUBSET)


def _batch_lookups(spark, sf_dir) -> DataFrame:
    """Per supplier: two latest reads, one live window, one that never was, one bad name."""
    key = F.col("s_suppkey")
    none = F.lit(None).cast("timestamp")
    day = F.timestamp_millis(
        F.lit(946_684_800_000) + key * F.lit(24 * HOUR) + F.lit(600_000) * (key % 144)
    )
    asks = [
        ("request_count_total", none),
        ("entity_error_rate_10m", none),
        ("entity_event_count_10m", day),
        ("request_count_total", day),
        ("unknown_feature", none),
    ]
    return views.service_entities(spark, sf_dir).select(
        "entity_type",
        "entity_id",
        F.posexplode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("feature_name"), at.alias("window_start"))
                    for n, at in asks
                ]
            )
        ).alias("pos", "ask"),
    ).select("pos", "entity_type", "entity_id", "ask.feature_name", "ask.window_start")


@query
def read_batch(spark, sf_dir):
    return serving.read_computed(
        _batch_lookups(spark, sf_dir),
        views.request_log(spark, sf_dir),
        BUILT_IN_FEATURES,
        instant("2000-01-02 00:00:00"),
        registry=_registry(spark, sf_dir),
    ).drop("value_text")


def _stored_values(spark, sf_dir) -> DataFrame:
    """Latest value per event id, some absent, some unreadable, some without a write time."""
    n = F.col("seq")
    text = (
        F.when(n % 7 == 0, F.lit(None).cast("string"))
        .when(n % 7 == 1, "abc")
        .when(n % 7 == 2, "0")
        .when(n % 7 == 3, "1e3")
        .otherwise(n.cast("string"))
    )
    return views.user_events(spark, sf_dir).select(
        "event_id",
        F.col("event_type").alias("kind"),
        text.alias("value_text"),
        F.when(n % 5 > 0, F.col("event_time")).alias("updated_at"),
        F.col("arrival_time").alias("now"),
    )


@query
def read_status(spark, sf_dir):
    """Status of stored values read 0 to 12 minutes after their write."""
    return _stored_values(spark, sf_dir).select(
        "event_id",
        serving.read_status(F.col("value_text"), F.col("updated_at"), F.col("now")).alias(
            "status"
        ),
        parse_value(F.col("value_text")).alias("value"),
    )


@query
def freshness(spark, sf_dir):
    return _stored_values(spark, sf_dir).select(
        "event_id",
        serving.freshness_ms(F.col("updated_at"), F.col("now")).alias("freshness_ms"),
    )


# --- baseline ---------------------------------------------------------------------------------


def _history(spark, sf_dir, run_id: str | None = None, phase: str | None = None) -> DataFrame:
    return history_source.scan_history(
        views.request_history(spark, sf_dir),
        event_type=REQUEST_COMPLETED,
        run_id=run_id,
        phase=phase,
    )


@query
def baseline_total(spark, sf_dir):
    return baseline.totals(_history(spark, sf_dir))


@query
def baseline_latest(spark, sf_dir):
    rows = baseline.windows(_history(spark, sf_dir), baseline.ERROR_RATE)
    return baseline.latest(rows)


@query
def baseline_window(spark, sf_dir):
    """Weighted latency in five minutes from every request on: aligned or not."""
    history = _history(spark, sf_dir)
    lookups = history.select("entity_type", "entity_id", F.col("event_time").alias("window_start"))
    return baseline.specific_windows(history, lookups, baseline.LATENCY)


def _baseline_query(name: str, feature_name: str) -> None:
    def run(spark, sf_dir):
        return baseline.windows(_history(spark, sf_dir), feature_name)

    run.__name__, run.__doc__ = name, f"Every window of {feature_name}, from history."
    query(run)


_baseline_query("baseline_count", baseline.EVENT_COUNT)
_baseline_query("baseline_error_rate", baseline.ERROR_RATE)
_baseline_query("baseline_latency", baseline.LATENCY)


@query
def baseline_phase(spark, sf_dir):
    """A run without a named phase reads its measurement phase."""
    return baseline.totals(_history(spark, sf_dir, run_id="run-2"))


@query
def baseline_batch(spark, sf_dir):
    return baseline.read_baseline(
        _batch_lookups(spark, sf_dir),
        _history(spark, sf_dir),
        instant("2001-11-30 00:00:00"),
        registry=_registry(spark, sf_dir),
        stale_ms=24 * 30 * HOUR,
    )


def _report_query(name: str, feature_name: str) -> None:
    def run(spark, sf_dir):
        return baseline.report(_history(spark, sf_dir, run_id="run-1"), feature_name)

    run.__name__, run.__doc__ = name, f"The ten newest rows of {feature_name} in one run."
    query(run)


_report_query("report_total", baseline.TOTAL)
_report_query("report_count", baseline.EVENT_COUNT)
_report_query("report_error_rate", baseline.ERROR_RATE)
_report_query("report_latency", baseline.LATENCY)


# --- parity and measurements -----------------------------------------------------------------


def _compared(spark, sf_dir) -> DataFrame:
    """Realtime values of accepted events; history also holds the late ones."""
    log = views.request_log(spark, sf_dir).withColumn(
        "arrival_time", add_millis(F.col("event_time"), (F.col("l_orderkey") % 13) * MINUTE)
    )
    realtime = compute_features(reject_late(log), BUILT_IN_FEATURES)
    names = [d.name for d in BUILT_IN_FEATURES]
    return parity.compare(realtime, baseline.all_windows(_history(spark, sf_dir)), names)


@query
def parity_summary(spark, sf_dir):
    return parity.summary(_compared(spark, sf_dir), "feature_name")


@query
def parity_examples(spark, sf_dir):
    return parity.examples(_compared(spark, sf_dir))


@query
def latency_summary(spark, sf_dir):
    return measurements.latency_summary(views.measurements(spark, sf_dir), "type")


@query
def operation_summary(spark, sf_dir):
    return measurements.operation_summary(views.measurements(spark, sf_dir), "type")


@query
def status_counts(spark, sf_dir):
    return measurements.status_counts(views.measurements(spark, sf_dir), "phase")


def _targets(spark, sf_dir) -> DataFrame:
    """Two targets per (phase, type), from the recorded operations themselves."""
    rows = views.measurements(spark, sf_dir)
    seen = rows.select("phase", "type").distinct()
    seconds = (F.unix_timestamp(instant(EVENTS_NOW)) - F.lit(1_704_067_200)).cast("double")
    return seen.select(
        "phase",
        "type",
        F.when(F.col("phase") == "warmup", F.lit(0.00001)).otherwise(F.lit(0.001)).alias(
            "rate_per_second"
        ),
        seconds.alias("duration_seconds"),
        F.lit(2_500).cast("bigint").alias("slo_ms"),
    )


@query
def slo_summary(spark, sf_dir):
    return measurements.throughput(views.measurements(spark, sf_dir), _targets(spark, sf_dir))


@query
def phase_summary(spark, sf_dir):
    return measurements.phase_summary(views.measurements(spark, sf_dir))


@query
def availability_latency(spark, sf_dir):
    """Purchases as probes; later clicks of the user as the raises that show them."""
    events = views.user_events(spark, sf_dir)
    user = F.col("entity.id").alias("entity_id")
    probes = events.where(F.col("event_type") == "purchase").select(
        user,
        F.col("event_id").alias("probe_id"),
        F.col("event_time").alias("started_at"),
        F.col("arrival_time").alias("ack_at"),
    )
    raises = events.where((F.col("event_type") == "click") & (F.col("payload.value") > 0)).select(
        user, F.col("arrival_time").alias("updated_at")
    )
    return measurements.availability(probes, raises, 6 * HOUR, ["entity_id"])


@query
def expected_values(spark, sf_dir):
    log = views.request_log(spark, sf_dir).select(
        F.col("entity.id").alias("entity_id"),
        F.col("payload.count").alias("count"),
        F.col("payload.statusCode").alias("status_code"),
        F.col("payload.latencyMs").alias("latency_ms"),
    )
    return measurements.expected_values(log, "entity_id")


@query
def raw_rows(spark, sf_dir):
    return measurements.raw_rows(
        views.measurements(spark, sf_dir), ["started_at", "event_id"], 1000
    )


# --- monitoring ----------------------------------------------------------------------------------


@query
def outcome_counts(spark, sf_dir):
    return monitoring.outcome_counts(_outcomes(spark, sf_dir))


@query
def outcome_rates(spark, sf_dir):
    return monitoring.outcome_rates(_outcomes(spark, sf_dir))


@query
def lag_quantiles(spark, sf_dir):
    return monitoring.lag_quantiles(_outcomes(spark, sf_dir), "timing")


@query
def freshness_quantiles(spark, sf_dir):
    values = _stored_values(spark, sf_dir)
    reads = values.select(
        "kind",
        # Some clocks run behind the write.
        (
            serving.freshness_ms(F.col("updated_at"), F.col("now"))
            - F.lit(2 * MINUTE)
        ).alias("freshness_ms"),
    )
    return monitoring.freshness_quantiles(reads, "kind")


@query
def read_status_counts(spark, sf_dir):
    reads = _stored_values(spark, sf_dir).select(
        serving.read_status(F.col("value_text"), F.col("updated_at"), F.col("now")).alias("status")
    )
    return monitoring.read_status_counts(reads)


@query
def state_size(spark, sf_dir):
    """Bytes of feature state: key text plus the numbers kept per entry."""
    rows = compute_features(views.request_log(spark, sf_dir), BUILT_IN_FEATURES)
    return monitoring.state_size(monitoring.feature_state_entries(rows, BUILT_IN_FEATURES))


@query
def accepted_events(spark, sf_dir):
    """Events that feed features, after every check."""
    return accepted(_outcomes(spark, sf_dir)).select("event_id", "seq", "arrival_time")
