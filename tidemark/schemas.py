"""Table shapes, as DDL strings that ``spark.read.schema`` and ``createDataFrame`` accept."""

# A decoded event as it leaves the source, before any check. ``payload`` may instead be a
# struct when the source is columnar; field paths work on both.
EVENTS = """
    event_id string, event_type string, event_time timestamp,
    entity struct<type: string, id: string>, payload variant,
    namespace string, arrival_time timestamp, seq bigint
"""

RAW_MESSAGES = "namespace string, seq bigint, arrival_time timestamp, value string"

HISTORY = """
    event_id string, benchmark_run_id string, benchmark_phase string, event_type string,
    event_time timestamp, entity_type string, entity_id string, count_value bigint,
    status_code int, latency_ms bigint, event_json string
"""

REGISTRY = """
    name string, version int, event_type string, entity_type string, aggregation_type string,
    value_field string, weight_field string,
    filter_field string, filter_operator string, filter_value string,
    numerator_filter_field string, numerator_filter_operator string, numerator_filter_value string,
    window_type string, window_size string, slide string, state string
"""

PARTIALS = """
    entity_type string, entity_id string, feature_name string, definition_version int,
    window_start timestamp, distinct_value string,
    n bigint, num double, den double, updated_at timestamp
"""

FEATURE_ROWS = """
    entity_type string, entity_id string, feature_name string, definition_version int,
    window_start timestamp, value double, n bigint, num double, den double,
    updated_at timestamp, expires_at timestamp
"""

SERVING = """
    entity_type string, entity_id string, feature_name string, window_start timestamp,
    value_text string, updated_at timestamp, definition_version int, expires_at timestamp
"""

LOOKUPS = """
    pos bigint, entity_type string, entity_id string, feature_name string, window_start timestamp
"""

MEASUREMENTS = """
    phase string, type string, started_at timestamp, latency_ms bigint, entity_id string,
    feature_name string, status_code int, feature_status string, timeout boolean, success boolean
"""
