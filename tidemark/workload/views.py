"""Test tables in the shapes the engine works on.

``events`` become user events, ``lineitem`` a request log, ``part`` and ``supplier`` a
registry and changes to it. Arrival times, duplicates and defects follow from the row itself,
so that SQL can state the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.definitions import REQUEST_COMPLETED, FeatureDefinition, FieldFilter
from tidemark.functions.fields import compute_once
from tidemark.functions.windows import add_millis
from tidemark.session import prepare

MINUTE = 60_000
HOUR = 60 * MINUTE

EVENTS_NOW = "2024-01-31 00:00:00"
REQUESTS_NOW = "2001-12-01 00:00:00"

USER_FEATURES = (
    FeatureDefinition("purchase_value_total", "purchase", "SUM", "user", value_field="value"),
    FeatureDefinition(
        "click_count_10m", "click", "COUNT", "user", window_type="TUMBLING", window="10m"
    ),
    FeatureDefinition(
        "click_count_1h_15m",
        "click",
        "COUNT",
        "user",
        window_type="SLIDING",
        window="1h",
        slide="15m",
    ),
    FeatureDefinition(
        "big_purchase_share_1d",
        "purchase",
        "RATIO",
        "user",
        value_field="value",
        numerator_filter=FieldFilter("value", "GTE", "100"),
        window_type="TUMBLING",
        window="1d",
    ),
    FeatureDefinition(
        "avg_value_by_k_1d",
        "view",
        "AVG",
        "user",
        value_field="payload.value",
        weight_field="k",
        window_type="TUMBLING",
        window="1d",
    ),
    FeatureDefinition(
        "avg_value_1d",
        "view",
        "AVG",
        "user",
        value_field="value",
        window_type="TUMBLING",
        window="1d",
    ),
    FeatureDefinition(
        "distinct_k_1d",
        "click",
        "DISTINCT_COUNT",
        value_field="k",
        window_type="TUMBLING",
        window="1d",
    ),
    FeatureDefinition(
        "distinct_k_6h_1h",
        "signup",
        "DISTINCT_COUNT",
        "user",
        value_field="k",
        window_type="SLIDING",
        window="6h",
        slide="1h",
    ),
)


# Twenty thresholds on each of the five event types, as declarations of a registry table.
THRESHOLD_FEATURES = tuple(
    FeatureDefinition(
        f"{kind}_over_{10 * step}",
        kind,
        "COUNT" if step % 2 else "SUM",
        "user",
        value_field="value",
        filter=FieldFilter("value", "GT", str(10 * step)),
        **({"window_type": "TUMBLING", "window": "7d"} if step % 4 == 1 else {}),
    )
    for kind in ("click", "error", "purchase", "signup", "view")
    for step in range(20)
)


def feature(name: str) -> FeatureDefinition:
    return next(d for d in USER_FEATURES if d.name == name)


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(result: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: instants without zone, doubles rounded."""
    columns = []
    for field in result.schema:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "double":
            column = F.round(column, digits)
        columns.append(column.alias(field.name))
    return result.select(*columns)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        at.alias("event_time"),
        F.struct(
            F.lit("user").alias("type"),
            F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("id"),
        ).alias("entity"),
        F.struct(
            "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
        ).alias("payload"),
        F.concat(F.lit("platform.events-"), (F.col("user_id") % 4).cast("string")).alias(
            "namespace"
        ),
        add_millis(at, (F.col("event_id") % 13) * MINUTE).alias("arrival_time"),
        F.col("event_id").alias("seq"),
    )


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events, every fifth delivered again one minute later."""
    events = user_events(spark, sf_dir)
    again = events.where(F.col("seq") % 5 == 0).withColumn(
        "arrival_time", add_millis(F.col("arrival_time"), MINUTE)
    ).withColumn("seq", F.col("seq") + F.lit(1_000_000_000_000))
    return events.unionByName(again)


def redelivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events, every seventh delivered again after 5, 24 and 30 hours."""
    events = user_events(spark, sf_dir)
    hours = F.when(F.col("seq") % 7 == 0, F.array(*[F.lit(h) for h in (0, 5, 24, 30)])).otherwise(
        F.array(F.lit(0))
    )
    return (
        events.withColumn("h", F.explode(hours))
        .withColumn("arrival_time", add_millis(F.col("arrival_time"), F.col("h") * F.lit(HOUR).cast("bigint")))
        .withColumn("seq", F.col("seq") + F.col("h") * F.lit(1_000_000_000_000))
        .drop("h")
    )


def variant_events(events: DataFrame, payload_json: Column) -> DataFrame:
    """The events with a JSON payload instead of typed columns."""
    others = [c for c in events.columns if c != "payload"]
    text = events.select(*others, payload_json.alias("payload_json"))
    parsed = compute_once(text, F.parse_json("payload_json").alias("payload"))
    return parsed.select(*events.columns)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 911) % 1440
    at = add_millis(F.col("l_shipdate").cast("timestamp"), minute * MINUTE)
    status = F.when(F.col("l_linenumber") % 7 == 0, F.lit(None).cast("bigint")).otherwise(
        F.when(F.col("l_returnflag") == "R", F.lit(500).cast("bigint")).otherwise(200)
    )
    latency = F.when(
        F.col("l_partkey") % 11 != 0, F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("event_id"),
        F.lit(REQUEST_COMPLETED).alias("event_type"),
        at.alias("event_time"),
        F.struct(
            F.lit("service").alias("type"),
            F.concat(F.lit("svc-"), F.col("l_suppkey").cast("string")).alias("id"),
        ).alias("entity"),
        F.struct(
            F.col("l_quantity").cast("bigint").alias("count"),
            status.alias("statusCode"),
            latency.alias("latencyMs"),
        ).alias("payload"),
        at.alias("arrival_time"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
    )


def request_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as history: missing numbers are 0; run and phase from the row."""
    log = request_log(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    return log.select(
        "event_id",
        F.concat(F.lit("run-"), (F.col("l_suppkey") % 3).cast("string")).alias(
            "benchmark_run_id"
        ),
        F.when(F.col("l_linenumber") == 1, "warmup").otherwise("measurement").alias(
            "benchmark_phase"
        ),
        "event_type",
        "event_time",
        F.col("entity.type").alias("entity_type"),
        F.col("entity.id").alias("entity_id"),
        F.coalesce("payload.count", zero).alias("count_value"),
        F.coalesce("payload.statusCode", zero).cast("int").alias("status_code"),
        F.coalesce("payload.latencyMs", zero).alias("latency_ms"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
    )


def service_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier, also for those without requests."""
    return table(spark, sf_dir, "supplier").select(
        F.lit("service").alias("entity_type"),
        F.concat(F.lit("svc-"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        "s_suppkey",
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_read = F.col("event_type").isin("view", "click")
    status = (
        F.when(F.col("event_id") % 3 == 0, "PRESENT")
        .when(F.col("event_id") % 3 == 1, "STALE")
        .otherwise("MISSING")
    )
    latency = (F.col("value") * 10).cast("bigint")
    code = F.when(F.col("event_type") == "error", 599).otherwise(200)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, "warmup").otherwise("measurement").alias("phase"),
        F.when(is_read, "feature_read").otherwise("event_publish").alias("type"),
        F.col("ts").cast("timestamp").alias("started_at"),
        latency.alias("latency_ms"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("entity_id"),
        F.when(is_read, F.lit("request_count_total")).alias("feature_name"),
        code.alias("status_code"),
        F.when(is_read, status).alias("feature_status"),
        (latency > 4000).alias("timeout"),
        ((code < 300) & (~is_read | (status == "PRESENT"))).alias("success"),
    )


def _pick(column: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions per name from ``part``; one is active, some rows are invalid."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number, version = F.floor(key / 4), (key % 4 + 1).cast("int")
    active = (number % 4 + 1).cast("int")
    nothing = F.lit(None).cast("string")
    is_ratio = (size % 5 == 4) & (key % 6 != 0)
    filtered = F.col("p_brand") == "Brand#2"
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("feature_"), number.cast("string")).alias("name"),
        version.alias("version"),
        _pick(size % 3, "request.completed", "click", "purchase").alias("event_type"),
        F.when(size % 4 == 0, "*").otherwise("service").alias("entity_type"),
        _pick(size % 5, "COUNT", "SUM", "AVG", "DISTINCT_COUNT", "RATIO").alias(
            "aggregation_type"
        ),
        F.when((size % 5 == 0) | (size % 13 == 0), nothing)
        .when(size % 11 == 0, "payload-count")
        .otherwise("count")
        .alias("value_field"),
        F.when(size % 5 == 2, "weight").otherwise(nothing).alias("weight_field"),
        F.when(filtered, "statusCode").alias("filter_field"),
        F.when(filtered, F.when(key % 2 == 0, "EXISTS").otherwise("GT")).alias(
            "filter_operator"
        ),
        F.when(filtered & (key % 4 == 1), "400").alias("filter_value"),
        F.when(is_ratio, "statusCode").alias("numerator_filter_field"),
        F.when(is_ratio, "GTE").alias("numerator_filter_operator"),
        F.when(is_ratio, "500").alias("numerator_filter_value"),
        _pick(size % 3, "NONE", "TUMBLING", "SLIDING").alias("window_type"),
        F.when((size % 3 == 0) & (key % 17 != 0), nothing)
        .when(key % 19 == 0, "PT0S")
        .when(key % 29 == 0, "ten-minutes")
        .otherwise("PT10M")
        .alias("window_size"),
        F.when(size % 3 == 2, F.when(key % 23 == 0, "PT15M").otherwise("PT5M")).alias("slide"),
        F.when(version == active, "ACTIVE")
        .when(version < active, "INACTIVE")
        .otherwise("DRAFT")
        .alias("state"),
    )


def registry_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves from ``supplier``: three per name, partly new versions, partly active."""
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("feature_"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("name"),
        (F.col("s_nationkey") % 6 + 1).cast("int").alias("version"),
        F.lit("click").alias("event_type"),
        F.lit("user").alias("entity_type"),
        F.lit("COUNT").alias("aggregation_type"),
        nothing.alias("value_field"),
        nothing.alias("weight_field"),
        nothing.alias("filter_field"),
        nothing.alias("filter_operator"),
        nothing.alias("filter_value"),
        nothing.alias("numerator_filter_field"),
        nothing.alias("numerator_filter_operator"),
        nothing.alias("numerator_filter_value"),
        F.lit("TUMBLING").alias("window_type"),
        F.concat(F.lit("PT"), (F.col("s_suppkey") % 59 + 1).cast("string"), F.lit("M")).alias(
            "window_size"
        ),
        nothing.alias("slide"),
        F.when(F.col("s_nationkey") % 3 == 0, "ACTIVE").otherwise("DRAFT").alias("state"),
        F.col("s_suppkey").alias("save_seq"),
    )


def registry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (name, version) per supplier to activate or deactivate; version 5 never exists."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("feature_"), F.col("s_suppkey").cast("string")).alias("name"),
        (F.col("s_nationkey") % 5 + 1).cast("int").alias("version"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages, with one defect each for eleven of twenty ids."""
    case = F.col("event_id") % 20
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    id_text = F.when(case == 4, F.col("event_id").cast("string")).otherwise(
        quoted(F.col("event_id").cast("string"))
    )
    kind = (
        F.when(case == 5, " ").when(case == 11, REQUEST_COMPLETED).otherwise(F.col("event_type"))
    )
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    time_text = (
        F.when(case == 6, quoted(day))
        .when(case == 7, F.lit("1700000000"))
        .otherwise(quoted(F.concat(day, F.lit("T"), clock, F.lit("Z"))))
    )
    user = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    entity = (
        F.when(case == 8, F.concat(F.lit('{"type": " ", "id": '), quoted(user), F.lit("}")))
        .when(case == 9, F.lit('{"type": "user"}'))
        .otherwise(F.concat(F.lit('{"type": "user", "id": '), quoted(user), F.lit("}")))
    )
    k = F.get_json_object("props", "$.k")
    payload = (
        F.when(case == 3, F.lit("[1]"))
        .when(case == 10, F.lit("null"))
        .when(case == 11, F.concat(F.lit('{"count": '), k, F.lit('.9, "statusCode": 200}')))
        .when(case == 12, F.concat(F.lit('{"k": 0, "k": '), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    )
    text = F.concat(
        F.lit('{"eventId": '), id_text,
        F.lit(', "eventType": '), quoted(kind),
        F.lit(', "eventTime": '), time_text,
        F.when(case == 2, F.lit("")).otherwise(F.concat(F.lit(', "entity": '), entity)),
        F.lit(', "trace": {"span": 1}, "payload": '), payload,
        F.when(case == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("platform.events-"), (F.col("user_id") % 4).cast("string")).alias(
            "namespace"
        ),
        F.col("event_id").alias("seq"),
        add_millis(F.col("ts").cast("timestamp"), (F.col("event_id") % 13) * MINUTE).alias(
            "arrival_time"
        ),
        F.when(case == 1, F.lit("[1]")).otherwise(text).alias("value"),
    )
