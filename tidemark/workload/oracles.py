"""The same questions in SQL, for an independent engine over the same tables."""

from __future__ import annotations

EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
REQUESTS_NOW = "TIMESTAMP '2001-12-01 00:00:00'"
ORIGIN = "TIMESTAMP '1970-01-01 00:00:00'"

# --- the test tables in event shape ---------------------------------------------------------

USER = """u AS (
  SELECT cast(event_id AS varchar) AS event_id, event_type, ts AS event_time,
         'user' AS entity_type, 'u-' || user_id AS entity_id, value,
         cast(json_extract_string(props, '$.k') AS bigint) AS k,
         'platform.events-' || (user_id % 4) AS namespace,
         ts + to_minutes(cast(event_id % 13 AS int)) AS arrival_time, event_id AS seq
  FROM events)"""

REPEATED = (
    USER
    + """, r AS (
  SELECT * FROM u
  UNION ALL
  SELECT * REPLACE (arrival_time + INTERVAL 1 MINUTE AS arrival_time,
                    seq + 1000000000000 AS seq)
  FROM u WHERE seq % 5 = 0)"""
)

# Markers are kept in whole milliseconds, as epoch millis are.
REDELIVERED = (
    USER
    + """, r AS (
  SELECT namespace, event_id, epoch_us(arrival_time) // 1000 + h * 3600000 AS at_ms,
         seq + h * 1000000000000 AS seq, h
  FROM u, (VALUES (0), (5), (24), (30)) t(h)
  WHERE h = 0 OR seq % 7 = 0)"""
)

LOG = """l AS (
  SELECT *, 'request.completed' AS event_type, 'service' AS entity_type,
         'svc-' || l_suppkey AS entity_id, l_orderkey || '-' || l_linenumber AS event_id,
         l_shipdate + to_minutes(cast((l_orderkey * 37 + l_linenumber * 911) % 1440 AS int))
           AS event_time,
         cast(l_quantity AS bigint) AS cnt,
         CASE WHEN l_linenumber % 7 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 500 ELSE 200 END
           AS status,
         CASE WHEN l_partkey % 11 = 0 THEN NULL
              ELSE cast(floor(l_extendedprice / 100) AS bigint) END AS lat
  FROM lineitem)"""

HISTORY = (
    LOG
    + """, h AS (
  SELECT event_id, 'run-' || (l_suppkey % 3) AS run_id,
         CASE WHEN l_linenumber = 1 THEN 'warmup' ELSE 'measurement' END AS phase,
         event_time, entity_type, entity_id, cnt AS count_value,
         cast(coalesce(status, 0) AS int) AS status_code, coalesce(lat, 0) AS latency_ms,
         l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM l)"""
)

MEASURED = """m AS (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'warmup' ELSE 'measurement' END AS phase,
         CASE WHEN event_type IN ('view', 'click') THEN 'feature_read' ELSE 'event_publish' END
           AS type,
         ts AS started_at, cast(trunc(value * 10) AS bigint) AS latency_ms,
         'u-' || user_id AS entity_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'request_count_total' END
           AS feature_name,
         cast(CASE WHEN event_type = 'error' THEN 599 ELSE 200 END AS int) AS status_code,
         CASE WHEN event_type IN ('view', 'click') THEN
           CASE event_id % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'STALE' ELSE 'MISSING' END
         END AS feature_status,
         trunc(value * 10) > 4000 AS timeout,
         event_type <> 'error'
           AND (event_type NOT IN ('view', 'click') OR event_id % 3 = 0) AS success
  FROM events)"""

REGISTRY = """g AS (
  SELECT 'feature_' || (p_partkey // 4) AS name, cast(p_partkey % 4 + 1 AS int) AS version,
         CASE p_size % 3 WHEN 0 THEN 'request.completed' WHEN 1 THEN 'click'
                         ELSE 'purchase' END AS event_type,
         CASE WHEN p_size % 4 = 0 THEN '*' ELSE 'service' END AS entity_type,
         CASE p_size % 5 WHEN 0 THEN 'COUNT' WHEN 1 THEN 'SUM' WHEN 2 THEN 'AVG'
                         WHEN 3 THEN 'DISTINCT_COUNT' ELSE 'RATIO' END AS aggregation_type,
         CASE WHEN p_size % 5 = 0 OR p_size % 13 = 0 THEN NULL
              WHEN p_size % 11 = 0 THEN 'payload-count' ELSE 'count' END AS value_field,
         CASE WHEN p_size % 5 = 2 THEN 'weight' END AS weight_field,
         CASE WHEN p_brand = 'Brand#2' THEN 'statusCode' END AS filter_field,
         CASE WHEN p_brand = 'Brand#2' THEN
              CASE WHEN p_partkey % 2 = 0 THEN 'EXISTS' ELSE 'GT' END END AS filter_operator,
         CASE WHEN p_brand = 'Brand#2' AND p_partkey % 4 = 1 THEN '400' END AS filter_value,
         CASE WHEN p_size % 5 = 4 AND p_partkey % 6 <> 0 THEN 'statusCode' END
           AS numerator_filter_field,
         CASE WHEN p_size % 5 = 4 AND p_partkey % 6 <> 0 THEN 'GTE' END
           AS numerator_filter_operator,
         CASE WHEN p_size % 5 = 4 AND p_partkey % 6 <> 0 THEN '500' END
           AS numerator_filter_value,
         CASE p_size % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TUMBLING' ELSE 'SLIDING' END
           AS window_type,
         CASE WHEN p_size % 3 = 0 AND p_partkey % 17 <> 0 THEN NULL
              WHEN p_partkey % 19 = 0 THEN 'PT0S' WHEN p_partkey % 29 = 0 THEN 'ten-minutes'
              ELSE 'PT10M' END AS window_size,
         CASE WHEN p_size % 3 = 2 THEN
              CASE WHEN p_partkey % 23 = 0 THEN 'PT15M' ELSE 'PT5M' END END AS slide,
         CASE WHEN p_partkey % 4 = (p_partkey // 4) % 4 THEN 'ACTIVE'
              WHEN p_partkey % 4 < (p_partkey // 4) % 4 THEN 'INACTIVE'
              ELSE 'DRAFT' END AS state
  FROM part)"""

SAVES = """s AS (
  SELECT 'feature_' || (s_suppkey // 3) AS name, cast(s_nationkey % 6 + 1 AS int) AS version,
         'click' AS event_type, 'COUNT' AS aggregation_type,
         'PT' || (s_suppkey % 59 + 1) || 'M' AS window_size,
         CASE WHEN s_nationkey % 3 = 0 THEN 'ACTIVE' ELSE 'DRAFT' END AS state,
         s_suppkey AS save_seq
  FROM supplier)"""

TARGETS = """t AS (
  SELECT 'feature_' || s_suppkey AS name, cast(s_nationkey % 5 + 1 AS int) AS version
  FROM supplier)"""

# The built-in declarations as registry rows.
BUILT_IN_ROWS = """b AS (
  SELECT * FROM (VALUES
    ('request_count_total', 1, 'request.completed', 'service', 'SUM', 'count', NULL,
     NULL, NULL, NULL, NULL, NULL, NULL, 'NONE', NULL, NULL, 'ACTIVE'),
    ('entity_event_count_10m', 1, 'request.completed', 'service', 'COUNT', NULL, NULL,
     NULL, NULL, NULL, NULL, NULL, NULL, 'TUMBLING', 'PT10M', 'PT10M', 'ACTIVE'),
    ('entity_error_rate_10m', 1, 'request.completed', 'service', 'RATIO', 'count', NULL,
     'statusCode', 'EXISTS', NULL, 'statusCode', 'GTE', '500', 'TUMBLING', 'PT10M', 'PT10M',
     'ACTIVE'),
    ('entity_avg_latency_ms_5m', 1, 'request.completed', 'service', 'AVG', 'latencyMs', 'count',
     'latencyMs', 'EXISTS', NULL, NULL, NULL, NULL, 'TUMBLING', 'PT5M', 'PT5M', 'ACTIVE')
  ) v(name, version, event_type, entity_type, aggregation_type, value_field, weight_field,
      filter_field, filter_operator, filter_value, numerator_filter_field,
      numerator_filter_operator, numerator_filter_value, window_type, window_size, slide, state))"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def bucket(minutes: int, column: str = "event_time") -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, {column}, {ORIGIN})"


# --- features ---------------------------------------------------------------------------------


def _feature(name, source, where, value, minutes=None, slide=None, n="count(*)") -> str:
    """SELECT of one feature: no window, tumbling ``minutes``, or sliding by ``slide``."""
    if minutes is None:
        start, table, ttl = "cast(NULL AS timestamp)", source, None
    elif slide is None:
        start, table, ttl = bucket(minutes), source, 2 * minutes
    else:
        back = f"{bucket(slide)} - to_minutes(cast(i * {slide} AS int))"
        start, table, ttl = back, f"{source}, range({minutes // slide}) w(i)", minutes + slide
    expires = (
        "cast(NULL AS timestamp)"
        if ttl is None
        else f"date_trunc('millisecond', max(arrival_time)) + INTERVAL {ttl} MINUTE"
    )
    return f"""
  SELECT entity_type, entity_id, '{name}' AS feature_name, {start} AS window_start,
         round(cast({value} AS double), 6) AS value, {n} AS n,
         max(arrival_time) AS updated_at, {expires} AS expires_at
  FROM {table} WHERE {where} GROUP BY 1, 2, 4"""


def user_features(source: str = "u") -> dict[str, str]:
    big = "CASE WHEN value >= 100 THEN value ELSE 0 END"
    quotient = "CASE WHEN sum({1}) = 0 THEN 0 ELSE sum({0}) / sum({1}) END"
    ask = [
        ("purchase_value_total", "purchase", "sum(value)", None, None),
        ("click_count_10m", "click", "count(*)", 10, None),
        ("click_count_1h_15m", "click", "count(*)", 60, 15),
        ("big_purchase_share_1d", "purchase", quotient.format(big, "value"), 1440, None),
        ("avg_value_by_k_1d", "view", quotient.format("value * k", "k"), 1440, None),
        ("avg_value_1d", "view", "avg(value)", 1440, None),
        ("distinct_k_1d", "click", "count(DISTINCT k)", 1440, None),
        ("distinct_k_6h_1h", "signup", "count(DISTINCT k)", 360, 60),
    ]
    return {
        name: _feature(name, source, f"event_type = '{kind}'", value, size, slide)
        for name, kind, value, size, slide in ask
    }


def all_user_features(source: str = "u") -> str:
    return "f AS (" + "\n  UNION ALL".join(user_features(source).values()) + ")"


def built_in_features(source: str = "l") -> str:
    """The four built-ins over a request log with ``cnt``, ``status``, ``lat``."""
    failed = "sum(CASE WHEN status >= 500 THEN cnt ELSE 0 END)"
    parts = [
        _feature("request_count_total", source, "true", "sum(cnt)"),
        _feature("entity_event_count_10m", source, "true", "count(*)", 10),
        _feature(
            "entity_error_rate_10m",
            source,
            "status IS NOT NULL",
            f"CASE WHEN sum(cnt) = 0 THEN 0 ELSE {failed} / sum(cnt) END",
            10,
        ),
        _feature(
            "entity_avg_latency_ms_5m",
            source,
            "lat IS NOT NULL",
            "CASE WHEN sum(cnt) = 0 THEN 0 ELSE sum(lat * cnt) / sum(cnt) END",
            5,
        ),
    ]
    return "f AS (" + "\n  UNION ALL".join(parts) + ")"


LOG_ARRIVED = "la AS (SELECT *, event_time AS arrival_time FROM l)"
BUILT_IN = (LOG, LOG_ARRIVED, built_in_features("la"))

COLUMNS = "entity_type, entity_id, feature_name, window_start, value"

LATEST = """x AS (
  SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, feature_name
                               ORDER BY window_start DESC NULLS LAST) AS rn
  FROM f)"""

KEY = "'feature:' || entity_type || ':' || entity_id || ':' || feature_name"
WINDOW_KEY = KEY + " || ':window:' || epoch_ms(window_start)"

# Values that print as doubles or as whole numbers read back the same.
SERVED = f"""
SELECT {WINDOW_KEY} AS feature_key, value, updated_at, cast(1 AS int) AS definition_version,
       expires_at
FROM f WHERE window_start IS NOT NULL
UNION ALL
SELECT {KEY}, value, updated_at, 1, NULL FROM x WHERE rn = 1"""

# Window length plus slide of the windowed user features, in minutes.
USER_TTL = """CASE feature_name
  WHEN 'click_count_10m' THEN 20 WHEN 'click_count_1h_15m' THEN 75
  WHEN 'distinct_k_6h_1h' THEN 420 ELSE 2880 END"""

ORACLES: dict[str, str] = {}

# --- sources, sinks, decoding -----------------------------------------------------------------

ORACLES["decode_events"] = (
    with_(
        USER,
        """d AS (SELECT *, seq % 20 AS defect,
         CASE seq % 20 WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'malformed_json'
           WHEN 2 THEN 'entity_not_object' WHEN 3 THEN 'payload_not_object'
           WHEN 4 THEN 'bad_event_id' WHEN 5 THEN 'bad_event_type'
           WHEN 6 THEN 'unparsable_event_time' WHEN 7 THEN 'bad_event_time'
           WHEN 8 THEN 'bad_entity_type' WHEN 9 THEN 'bad_entity_id'
           WHEN 10 THEN 'payload_not_object' END AS problem FROM u)""",
    )
    + """SELECT seq, CASE WHEN problem IS NULL THEN event_id END AS event_id,
       CASE WHEN problem IS NULL THEN
         CASE WHEN defect = 11 THEN 'request.completed' ELSE event_type END END AS event_type,
       CASE WHEN problem IS NULL THEN event_time END AS event_time,
       CASE WHEN problem IS NULL THEN entity_id END AS entity_id,
       CASE WHEN problem IS NULL AND defect <> 11 THEN k END AS k,
       CASE WHEN defect = 11 THEN k END AS count, problem
FROM d"""
)

ORACLES["normalize_payload"] = with_(USER) + """
SELECT event_id,
       CASE WHEN event_type = 'view' THEN 'request.completed' ELSE event_type END AS event_type,
       round(CASE WHEN event_type = 'view' THEN trunc(value) ELSE value END, 6) AS count,
       round(value, 6) AS other, '7.9' AS latency_text
FROM u"""

ORACLES["encode_events"] = with_(USER) + """
SELECT event_id,
       '{"eventId":"' || event_id || '","eventType":"' || event_type || '","eventTime":"'
       || strftime(event_time, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN ''
               WHEN epoch_us(event_time) % 1000 = 0
               THEN '.' || lpad(cast((epoch_us(event_time) % 1000000) // 1000 AS varchar), 3, '0')
               ELSE '.' || lpad(cast(epoch_us(event_time) % 1000000 AS varchar), 6, '0') END
       || 'Z","entity":{"type":"user","id":"' || entity_id || '"},"payload":{"k":' || k
       || ',"kind":"' || event_type || '"}}' AS json
FROM u"""

ORACLES["history_append"] = with_(
    HISTORY,
    """n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_time, l_partkey,
           l_suppkey, l_quantity, l_extendedprice) AS rn FROM h)""",
) + """
SELECT event_id, entity_id, event_time, count_value, status_code, latency_ms
FROM n WHERE rn = 1 AND event_id NOT IN
  (SELECT o_orderkey || '-1' FROM orders WHERE o_orderstatus = 'F')"""

ORACLES["history_scan"] = with_(HISTORY) + """
SELECT event_id, entity_id, event_time, count_value, status_code, latency_ms
FROM h WHERE run_id = 'run-1' AND phase = 'measurement'"""

ON_TIME_USER = """o AS (SELECT * FROM u
  WHERE event_time >= arrival_time - INTERVAL 10 MINUTE)"""

ORACLES["materialize_rows"] = (
    with_(USER, ON_TIME_USER, all_user_features("o"), LATEST) + SERVED
)

ORACLES["republish"] = with_(USER, all_user_features(), f"""
  a AS (SELECT * REPLACE (CASE WHEN window_start IS NOT NULL
                 THEN window_start + to_minutes({USER_TTL}) END AS expires_at,
                 TIMESTAMP '2024-01-30 12:00:00' AS updated_at) FROM f),
  k AS (SELECT * FROM a WHERE window_start IS NULL
           OR expires_at > TIMESTAMP '2024-01-30 12:00:00')""",
    LATEST.replace("FROM f)", "FROM k)"),
) + SERVED.replace("FROM f ", "FROM k ")

# --- validation, projection, filters ------------------------------------------------------------

ORACLES["validate_events"] = with_(
    USER,
    """c AS (SELECT *,
         CASE WHEN event_type IN ('view', 'click') THEN 'request.completed'
              WHEN event_type = 'error' THEN ' ' ELSE event_type END AS kind,
         CASE seq % 9 WHEN 3 THEN -k WHEN 4 THEN 0 ELSE k END AS cnt,
         seq % 701 AS status, seq % 31 - 2 AS lat FROM u)""",
) + """
SELECT event_id,
       CASE WHEN kind = ' ' THEN 'blank_event_type'
            WHEN seq % 10 = 7 THEN 'future_event'
            WHEN kind <> 'request.completed' THEN NULL
            WHEN seq % 9 IN (0, 1) THEN 'count_missing'
            WHEN seq % 9 = 2 THEN 'count_not_numeric'
            WHEN cnt < 0 THEN 'count_negative'
            WHEN seq % 11 = 0 THEN 'status_not_numeric'
            WHEN status < 100 OR status > 599 THEN 'status_out_of_range'
            WHEN lat < 0 THEN 'latency_negative' END AS problem
FROM c"""

_INSTANT_TEXT = """strftime(event_time, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN ''
               WHEN epoch_us(event_time) % 1000 = 0
               THEN '.' || lpad(cast((epoch_us(event_time) % 1000000) // 1000 AS varchar), 3, '0')
               ELSE '.' || lpad(cast(epoch_us(event_time) % 1000000 AS varchar), 6, '0') END
       || 'Z'"""

ORACLES["field_paths"] = with_(
    USER, "c AS (SELECT * REPLACE (CASE WHEN seq % 10 = 3 THEN NULL ELSE k END AS k) FROM u)"
) + f"""
SELECT event_id, event_id AS id_text, {_INSTANT_TEXT} AS time_text, entity_id AS entity_text,
       k IS NOT NULL AS k_present, cast(k AS varchar) AS k_text,
       round(cast(k AS double), 6) AS k_number, round(value, 6) AS value_number,
       event_type AS os_text, false AS os_is_number, false AS through_list,
       false AS missing, false AS prefixed_twice
FROM c"""

for _name, _op in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
    ORACLES[f"filter_{_name}"] = with_(USER) + f"""
SELECT event_id, coalesce(CASE WHEN seq % 10 = 3 THEN NULL ELSE k END {_op} 50, false)
         AS number_matches,
       event_type {_op} 'purchase' AS text_matches, false AS missing_matches,
       entity_id {_op} 'u-7' AS entity_matches, seq % 10 <> 3 AS unusable,
       value {_op} 100 AS column_matches
FROM u"""

ORACLES["filter_exists"] = with_(USER) + """
SELECT event_id, seq % 10 <> 3 AS number_matches, true AS text_matches,
       false AS missing_matches, true AS entity_matches, false AS unusable,
       true AS column_matches
FROM u"""

ORACLES["feature_keys"] = with_(USER) + f"""
SELECT event_id,
       CASE WHEN seq % 10 <> 4 THEN 'feature:user:' || entity_id || ':click_count_10m'
         || CASE WHEN seq % 3 > 0 THEN ':window:' || epoch_ms({bucket(10)}) ELSE '' END END
         AS feature_key,
       CASE WHEN seq % 10 = 4 THEN 'bad_key' END AS problem
FROM u"""

ORACLES["parse_keys"] = with_(
    USER,
    """c AS (SELECT *, seq % 10 <> 4 AND NOT (seq % 10 = 5 AND seq % 3 > 0) AS is_key FROM u)""",
) + f"""
SELECT event_id, is_key, CASE WHEN is_key THEN entity_type END AS entity_type,
       CASE WHEN is_key THEN entity_id END AS entity_id,
       CASE WHEN is_key THEN event_type END AS feature_name,
       CASE WHEN is_key AND seq % 3 > 0 THEN {bucket(10)} END AS window_start
FROM c"""

ORACLES["value_text"] = with_(
    USER, "c AS (SELECT event_id, CASE WHEN seq % 2 = 0 THEN floor(value) ELSE value END AS v FROM u)"
) + """
SELECT event_id,
       CASE WHEN v = trunc(v) THEN cast(cast(v AS bigint) AS varchar) ELSE cast(v AS varchar) END
         AS stored,
       round(v, 6) AS read_back
FROM c"""

# --- event time, dedup, outcome ------------------------------------------------------------------

TIMING = """CASE WHEN event_time < arrival_time - INTERVAL 10 MINUTE THEN 'TOO_LATE'
       WHEN event_time < arrival_time THEN 'LATE_WITHIN_ALLOWED' ELSE 'ON_TIME' END"""

ORACLES["lateness"] = with_(USER) + f"SELECT event_id, {TIMING} AS timing FROM u"

ORACLES["reject_late"] = (
    with_(USER, ON_TIME_USER) + "SELECT event_id, event_time, arrival_time FROM o"
)

ORACLES["dedup_first"] = with_(
    REPEATED,
    """c AS (SELECT *, row_number() OVER (PARTITION BY namespace, event_id
                                          ORDER BY arrival_time, seq) AS rn FROM r)""",
) + """
SELECT namespace, event_id, date_trunc('millisecond', arrival_time) AS taken_at,
       seq AS marker_seq
FROM c WHERE rn = 1"""

# Each arrival looks at the chain before it; a recursive step per taken arrival.
TAKEN = (
    REDELIVERED
    + """, k AS (
  SELECT namespace, event_id, min(at_ms) AS at_ms FROM r GROUP BY 1, 2
  UNION ALL
  SELECT k.namespace, k.event_id,
         (SELECT min(r.at_ms) FROM r WHERE r.namespace = k.namespace
            AND r.event_id = k.event_id AND r.at_ms >= k.at_ms + 86400000)
  FROM k WHERE k.at_ms IS NOT NULL), t AS (
  SELECT r.namespace, r.event_id, r.at_ms, r.seq FROM r JOIN k
    ON r.namespace = k.namespace AND r.event_id = k.event_id AND r.at_ms = k.at_ms)"""
)

ORACLES["dedup_retention"] = f"""WITH RECURSIVE {TAKEN}
SELECT namespace, event_id, make_timestamp(at_ms * 1000) AS taken_at, seq AS marker_seq
FROM t"""

ORACLES["live_markers"] = f"""WITH RECURSIVE {TAKEN}
SELECT namespace, event_id,
       make_timestamp((max(at_ms) + 86400000) * 1000) AS expires_at
FROM t GROUP BY 1, 2
HAVING max(at_ms) + 86400000 > epoch_ms(TIMESTAMP '2024-01-30 00:00:00')"""

# All copies of an id arrive within one retention, so the first marker covers the later ones.
OUTCOMES = (
    REPEATED
    + f""", c AS (
  SELECT *, seq % 1000000000000 AS i, {TIMING} AS t,
         greatest(0, cast(floor((epoch_us(arrival_time) - epoch_us(event_time)) / 1000)
                     AS bigint)) AS lag,
         (seq % 1000000000000) % 23 = 2 AS blank
  FROM r), e AS (
  SELECT *, NOT blank AND t <> 'TOO_LATE' AS on_time,
         CASE WHEN event_type IN ('purchase', 'view') AND i % 6 = 0 THEN true
              WHEN event_type IN ('purchase', 'view') AND i % 17 = 1 THEN true
              ELSE false END AS failing
  FROM c), d AS (
  SELECT *, min(CASE WHEN on_time AND NOT failing THEN seq END)
              OVER (PARTITION BY namespace, event_id) AS marker_seq
  FROM e), oc AS (
  SELECT *, CASE WHEN blank THEN 'invalid' WHEN NOT on_time THEN 'late'
                 WHEN seq > marker_seq THEN 'duplicate' WHEN failing THEN 'invalid'
                 WHEN event_type = 'error' THEN 'ignored' ELSE 'processed' END AS outcome,
         CASE WHEN NOT blank THEN t END AS timing, CASE WHEN NOT blank THEN lag END AS lag_ms,
         coalesce(NOT blank AND t = 'LATE_WITHIN_ALLOWED'
                  AND NOT coalesce(seq > marker_seq, false), false) AS late_accepted
  FROM d)"""
)

ORACLES["event_outcomes"] = (
    with_(OUTCOMES)
    + "SELECT event_id, seq, outcome, timing, lag_ms, late_accepted FROM oc"
)

ORACLES["accepted_events"] = (
    with_(OUTCOMES) + "SELECT event_id, seq, arrival_time FROM oc WHERE outcome = 'processed'"
)

ORACLES["ingestion_lag"] = with_(USER) + """
SELECT event_id, greatest(0, cast(floor((epoch_us(arrival_time) - epoch_us(event_time)) / 1000)
         AS bigint)) AS lag_ms
FROM u"""

# --- declarations -----------------------------------------------------------------------------------

ORACLES["match_definitions"] = with_(USER) + """
SELECT event_id, feature_name, cast(1 AS int) AS definition_version
FROM u JOIN (VALUES
  ('purchase', 'purchase_value_total'), ('click', 'click_count_10m'),
  ('click', 'click_count_1h_15m'), ('purchase', 'big_purchase_share_1d'),
  ('view', 'avg_value_by_k_1d'), ('view', 'avg_value_1d'), ('click', 'distinct_k_1d'),
  ('signup', 'distinct_k_6h_1h')) d(kind, feature_name) ON u.event_type = d.kind"""

ORACLES["registry_list"] = with_(REGISTRY, BUILT_IN_ROWS) + """
SELECT * FROM g UNION ALL SELECT * REPLACE (cast(version AS int) AS version) FROM b"""

ORACLES["registry_invalid"] = with_(
    REGISTRY,
    """v AS (SELECT name, version,
         CASE WHEN aggregation_type <> 'COUNT' AND value_field IS NULL THEN 'missing_value_field'
              WHEN value_field = 'payload-count' THEN 'bad_value_field'
              WHEN filter_operator = 'GT' AND filter_value IS NULL THEN 'blank_filter_value'
              WHEN aggregation_type = 'RATIO' AND numerator_filter_field IS NULL
                THEN 'missing_numerator_filter'
              WHEN window_type = 'NONE' AND (window_size IS NOT NULL OR slide IS NOT NULL)
                THEN 'unexpected_window'
              WHEN window_type <> 'NONE' AND window_size IN ('PT0S', 'ten-minutes')
                THEN 'bad_window_size'
              WHEN window_type = 'SLIDING' AND slide = 'PT15M' THEN 'slide_too_long' END
           AS reason FROM g)""",
) + "SELECT * FROM v WHERE reason IS NOT NULL"

ORACLES["registry_upsert"] = with_(
    REGISTRY,
    SAVES,
    """a AS (SELECT name, version, event_type, aggregation_type, window_size, state,
              cast(-1 AS bigint) AS save_seq FROM g
            UNION ALL SELECT * FROM s),
  l AS (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY save_seq DESC) AS rn
        FROM a)""",
) + """
SELECT name, version, event_type, aggregation_type, window_size,
       CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.name = l.name AND s.version <> l.version
                           AND s.state = 'ACTIVE' AND s.save_seq > l.save_seq)
            THEN 'INACTIVE' ELSE state END AS state
FROM l WHERE rn = 1"""

ORACLES["registry_activate"] = with_(
    REGISTRY, TARGETS, "k AS (SELECT t.* FROM t JOIN g USING (name, version))"
) + """
SELECT g.name, g.version,
       CASE WHEN k.name IS NULL THEN g.state WHEN k.version = g.version THEN 'ACTIVE'
            ELSE 'INACTIVE' END AS state
FROM g LEFT JOIN k ON g.name = k.name"""

ORACLES["registry_deactivate"] = with_(REGISTRY, TARGETS) + """
SELECT g.name, g.version, CASE WHEN t.name IS NULL THEN g.state ELSE 'INACTIVE' END AS state
FROM g LEFT JOIN t ON g.name = t.name AND g.version = t.version"""

ORACLES["registry_active"] = with_(REGISTRY) + """
SELECT name, version, event_type, aggregation_type, window_type FROM g WHERE state = 'ACTIVE'"""

ORACLES["registry_conflicts"] = with_(
    REGISTRY,
    SAVES,
    "a AS (SELECT name, version, state FROM g UNION ALL SELECT name, version, state FROM s)",
) + """
SELECT 'duplicate_version' AS conflict, name, version, count(*) AS entries
FROM a GROUP BY 2, 3 HAVING count(*) > 1
UNION ALL
SELECT 'many_active', name, NULL, count(*) FROM a WHERE state = 'ACTIVE'
GROUP BY 2 HAVING count(*) > 1"""

ORACLES["registry_summary"] = with_(REGISTRY) + """
SELECT count(*) AS total, count(*) FILTER (WHERE state = 'ACTIVE') AS active FROM g"""

# --- windows --------------------------------------------------------------------------------------

ORACLES["window_tumbling"] = (
    with_(USER) + f"SELECT event_id, {bucket(10)} AS window_start FROM u"
)

ORACLES["window_sliding"] = with_(
    USER, f"""c AS (SELECT event_id, event_time,
      {bucket(4)} - to_minutes(cast(4 * i AS int)) AS window_start FROM u, range(3) w(i))"""
) + """
SELECT event_id, window_start FROM c WHERE event_time < window_start + INTERVAL 10 MINUTE"""

ORACLES["window_newest"] = with_(USER) + f"SELECT event_id, {bucket(15)} AS window_start FROM u"

ORACLES["window_ttl"] = with_(USER, all_user_features()) + """
SELECT entity_id, feature_name, window_start, expires_at,
       CASE WHEN expires_at > TIMESTAMP '2024-01-29 12:00:00'
            THEN cast(floor((epoch_us(expires_at) - epoch_us(TIMESTAMP '2024-01-29 12:00:00'))
                 / 1000000) AS bigint) END AS ttl_seconds
FROM f WHERE feature_name IN ('click_count_1h_15m', 'avg_value_1d')"""

ORACLES["late_correction"] = with_(USER, ON_TIME_USER) + f"""
SELECT entity_id, {bucket(60)} AS window_start,
       count(*) FILTER (WHERE event_time >= arrival_time) AS on_time_events,
       count(*) AS events,
       round(sum(CASE WHEN event_time >= arrival_time THEN value ELSE 0 END), 6)
         AS on_time_value,
       round(sum(value), 6) AS corrected_value
FROM o GROUP BY 1, 2"""

# --- aggregations -----------------------------------------------------------------------------------

for _name, _feature_name in {
    "count_tumbling": "click_count_10m",
    "count_sliding": "click_count_1h_15m",
    "sum_total": "purchase_value_total",
    "ratio_tumbling": "big_purchase_share_1d",
    "avg_plain": "avg_value_1d",
    "avg_weighted": "avg_value_by_k_1d",
    "distinct_tumbling": "distinct_k_1d",
    "distinct_sliding": "distinct_k_6h_1h",
}.items():
    ORACLES[_name] = (
        with_(USER, f"f AS ({user_features()[_feature_name]})") + f"SELECT {COLUMNS} FROM f"
    )

ORACLES["busiest_sliding"] = with_(
    USER, f"f AS ({_feature('clicks_1d_1m', 'u', "event_type = 'click'", 'count(*)', 1440, 1)})"
) + """
SELECT entity_type, entity_id, count(*) AS windows, max(value) AS peak,
       min(window_start) FILTER (WHERE value = top) AS peak_start, cast(sum(n) AS bigint) AS counted
FROM (SELECT *, max(value) OVER (PARTITION BY entity_type, entity_id) AS top FROM f)
GROUP BY 1, 2"""

ORACLES["sum_tumbling"] = (
    with_(LOG, LOG_ARRIVED, f"f AS ({_feature('requests_1h', 'la', 'true', 'sum(cnt)', 60)})")
    + f"SELECT {COLUMNS} FROM f"
)

ORACLES["merge_partials"] = with_(USER, all_user_features()) + f"SELECT {COLUMNS}, n FROM f"
ORACLES["distinct_approx"] = with_(USER, all_user_features()) + """
SELECT entity_type, entity_id, feature_name, window_start, value AS exact, true AS close
FROM f WHERE feature_name IN ('distinct_k_1d', 'distinct_k_6h_1h')"""
ORACLES["features_all"] = with_(*BUILT_IN) + f"SELECT {COLUMNS}, n, updated_at FROM f"
ORACLES["user_features_all"] = (
    with_(USER, all_user_features()) + f"SELECT {COLUMNS}, n, updated_at, expires_at FROM f"
)

ORACLES["bad_values"] = with_(USER) + """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN NULL WHEN seq % 25 = 0 THEN 'bad_key'
            WHEN event_type = 'purchase' AND seq % 6 = 0 THEN 'value is not a number'
            WHEN event_type = 'view' AND seq % 6 = 0 THEN 'payload.value is not a number'
            WHEN event_type IN ('view', 'click', 'signup') AND seq % 7 = 0 THEN 'missing k' END
         AS reason
FROM u"""

# --- latest view, serving reads -----------------------------------------------------------------------

ORACLES["latest_alias"] = (
    with_(USER, all_user_features(), LATEST)
    + f"SELECT {COLUMNS}, updated_at FROM x WHERE rn = 1"
)

ORACLES["read_point"] = with_(
    *BUILT_IN, "q AS (SELECT * FROM f WHERE feature_name = 'entity_event_count_10m')"
) + """
SELECT entity_id, window_start,
       CASE WHEN expires_at > TIMESTAMP '1998-07-01 00:00:00' THEN value END AS value,
       CASE WHEN expires_at <= TIMESTAMP '1998-07-01 00:00:00' THEN 'MISSING'
            WHEN updated_at + INTERVAL 5 MINUTE < TIMESTAMP '1998-07-01 00:00:00' THEN 'STALE'
            ELSE 'PRESENT' END AS status,
       CASE WHEN expires_at > TIMESTAMP '1998-07-01 00:00:00'
            THEN cast(floor((epoch_us(expires_at) - epoch_us(TIMESTAMP '1998-07-01 00:00:00'))
                 / 1000000) AS bigint) END AS ttl_seconds
FROM q"""

SUBSET = """w AS (
  SELECT 'svc-' || s_suppkey AS entity_id, pos, feature_name
  FROM supplier, (VALUES (0, 'entity_avg_latency_ms_5m'), (1, 'unknown_feature'),
                         (2, 'request_count_total'), (3, 'entity_error_rate_10m'))
                 n(pos, feature_name))"""

ORACLES["read_subset"] = with_(*BUILT_IN, LATEST, SUBSET) + f"""
SELECT w.entity_id, cast(w.pos AS int) AS pos, w.feature_name, x.value,
       CASE WHEN x.value IS NULL THEN 'MISSING'
            WHEN x.updated_at + INTERVAL 5 MINUTE < {REQUESTS_NOW} THEN 'STALE'
            ELSE 'PRESENT' END AS status,
       cast(CASE WHEN w.feature_name <> 'unknown_feature' THEN 1 END AS int)
         AS definition_version
FROM w LEFT JOIN x ON x.rn = 1 AND x.entity_id = w.entity_id
                  AND x.feature_name = w.feature_name"""

ORACLES["feature_vector"] = with_(*BUILT_IN, LATEST) + """
SELECT 'service' AS entity_type, 'svc-' || s_suppkey AS entity_id,
       max(value) FILTER (WHERE feature_name = 'entity_avg_latency_ms_5m')
         AS entity_avg_latency_ms_5m,
       cast(NULL AS double) AS unknown_feature,
       max(value) FILTER (WHERE feature_name = 'request_count_total') AS request_count_total,
       max(value) FILTER (WHERE feature_name = 'entity_error_rate_10m') AS entity_error_rate_10m
FROM supplier LEFT JOIN x ON x.rn = 1 AND x.entity_id = 'svc-' || s_suppkey
GROUP BY s_suppkey"""

BATCH = f"""w AS (
  SELECT cast(pos AS int) AS pos, 'service' AS entity_type, 'svc-' || s_suppkey AS entity_id,
         feature_name,
         CASE WHEN windowed THEN TIMESTAMP '2000-01-01 00:00:00' + to_days(cast(s_suppkey AS int))
              + to_minutes(cast(10 * (s_suppkey % 144) AS int)) END AS window_start
  FROM supplier, (VALUES (0, 'request_count_total', false), (1, 'entity_error_rate_10m', false),
                         (2, 'entity_event_count_10m', true), (3, 'request_count_total', true),
                         (4, 'unknown_feature', false)) n(pos, feature_name, windowed))"""

ORACLES["read_batch"] = with_(
    *BUILT_IN,
    LATEST,
    BATCH,
    """z AS (SELECT entity_id, feature_name, window_start, value, updated_at, expires_at FROM f
        WHERE window_start IS NOT NULL AND expires_at > TIMESTAMP '2000-01-02 00:00:00'
        UNION ALL
        SELECT entity_id, feature_name, NULL, value, updated_at, NULL FROM x WHERE rn = 1)""",
) + """
SELECT w.pos, w.entity_type, w.entity_id, w.feature_name, w.window_start, z.value,
       CASE WHEN z.value IS NULL THEN 'MISSING'
            WHEN z.updated_at + INTERVAL 5 MINUTE < TIMESTAMP '2000-01-02 00:00:00' THEN 'STALE'
            ELSE 'PRESENT' END AS status,
       z.updated_at,
       cast(floor((epoch_us(TIMESTAMP '2000-01-02 00:00:00') - epoch_us(z.updated_at)) / 1000)
            AS bigint) AS freshness_ms,
       cast(CASE WHEN w.feature_name <> 'unknown_feature' THEN 1 END AS int)
         AS definition_version,
       cast(floor((epoch_us(z.expires_at) - epoch_us(TIMESTAMP '2000-01-02 00:00:00'))
            / 1000000) AS bigint) AS ttl_seconds
FROM w LEFT JOIN z ON z.entity_id = w.entity_id AND z.feature_name = w.feature_name
                  AND z.window_start IS NOT DISTINCT FROM w.window_start"""

STORED = (
    USER
    + """, v AS (
  SELECT event_id, event_type AS kind,
         CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '1e3'
              ELSE cast(seq AS varchar) END AS value_text,
         CASE WHEN seq % 5 > 0 THEN event_time END AS updated_at, arrival_time AS now
  FROM u), st AS (
  SELECT *, CASE WHEN value_text IS NULL THEN 'MISSING' WHEN value_text = 'abc' THEN 'UNAVAILABLE'
                 WHEN updated_at + INTERVAL 5 MINUTE < now THEN 'STALE' ELSE 'PRESENT' END
            AS status
  FROM v)"""
)

ORACLES["read_status"] = with_(STORED) + """
SELECT event_id, status, try_cast(value_text AS double) AS value FROM st"""

ORACLES["freshness"] = with_(STORED) + """
SELECT event_id, cast(floor((epoch_us(now) - epoch_us(updated_at)) / 1000) AS bigint)
         AS freshness_ms
FROM st"""

# --- baseline ------------------------------------------------------------------------------------------

H_RATE = """CASE WHEN sum(count_value) = 0 THEN 0
  ELSE sum(CASE WHEN status_code >= 500 THEN count_value ELSE 0 END) / sum(count_value) END"""
H_LATENCY = """CASE WHEN sum(count_value) = 0 THEN 0
  ELSE sum(latency_ms * count_value) / sum(count_value) END"""


def _baseline(feature: str, value: str, minutes: int | None, where: str = "true") -> str:
    start = "cast(NULL AS timestamp)" if minutes is None else bucket(minutes)
    return f"""
SELECT entity_type, entity_id, '{feature}' AS feature_name, {start} AS window_start,
       round(cast({value} AS double), 6) AS value, max(event_time) AS updated_at
FROM h WHERE {where} GROUP BY 1, 2, 4"""


_TOTAL = _baseline("request_count_total", "sum(count_value)", None)
_COUNT = _baseline("entity_event_count_10m", "count(*)", 10)
_RATE = _baseline("entity_error_rate_10m", H_RATE, 10)
_LATENCY = _baseline("entity_avg_latency_ms_5m", H_LATENCY, 5)
_BASELINE_COLUMNS = f"{COLUMNS}, updated_at"

ORACLES["baseline_total"] = with_(HISTORY) + _TOTAL
ORACLES["baseline_count"] = with_(HISTORY) + _COUNT
ORACLES["baseline_error_rate"] = with_(HISTORY) + _RATE
ORACLES["baseline_latency"] = with_(HISTORY) + _LATENCY
ORACLES["baseline_latest"] = (
    with_(HISTORY, f"f AS ({_RATE})", LATEST)
    + f"SELECT {_BASELINE_COLUMNS} FROM x WHERE rn = 1"
)
ORACLES["baseline_phase"] = with_(HISTORY) + _baseline(
    "request_count_total", "sum(count_value)", None, "run_id = 'run-2' AND phase = 'measurement'"
)

ORACLES["baseline_window"] = with_(
    HISTORY, "a AS (SELECT DISTINCT entity_id, event_time AS window_start FROM h)"
) + f"""
SELECT h.entity_type, h.entity_id, 'entity_avg_latency_ms_5m' AS feature_name, a.window_start,
       round(cast({H_LATENCY} AS double), 6) AS value, max(event_time) AS updated_at
FROM h JOIN a ON h.entity_id = a.entity_id AND h.event_time >= a.window_start
             AND h.event_time < a.window_start + INTERVAL 5 MINUTE
GROUP BY 1, 2, 4"""

ORACLES["baseline_batch"] = with_(
    HISTORY,
    f"f AS ({_TOTAL} UNION ALL {_RATE} UNION ALL {_COUNT})",
    LATEST,
    BATCH,
    """z AS (SELECT entity_id, feature_name, window_start AS asked, window_start, value,
                    updated_at FROM f WHERE window_start IS NOT NULL
        UNION ALL
        SELECT entity_id, feature_name, NULL, window_start, value, updated_at
        FROM x WHERE rn = 1)""",
) + """
SELECT w.pos, w.entity_type, w.entity_id, w.feature_name,
       coalesce(w.window_start, z.window_start) AS window_start, z.value,
       CASE WHEN z.value IS NULL THEN 'MISSING'
            WHEN z.updated_at + INTERVAL 720 HOUR < TIMESTAMP '2001-11-30 00:00:00' THEN 'STALE'
            ELSE 'PRESENT' END AS status,
       z.updated_at,
       cast(floor((epoch_us(TIMESTAMP '2001-11-30 00:00:00') - epoch_us(z.updated_at)) / 1000)
            AS bigint) AS freshness_ms,
       cast(CASE WHEN w.feature_name <> 'unknown_feature' THEN 1 END AS int)
         AS definition_version
FROM w LEFT JOIN z ON z.entity_id = w.entity_id AND z.feature_name = w.feature_name
                  AND z.asked IS NOT DISTINCT FROM w.window_start"""

_RUN_1 = "run_id = 'run-1' AND phase = 'measurement'"
_NEWEST = "\nORDER BY window_start DESC, entity_id, entity_type LIMIT 10"
ORACLES["report_total"] = (
    with_(HISTORY)
    + _baseline("request_count_total", "sum(count_value)", None, _RUN_1)
    + "\nORDER BY entity_id, entity_type LIMIT 10"
)
for _name, _feature_name, _value, _minutes in (
    ("report_count", "entity_event_count_10m", "count(*)", 10),
    ("report_error_rate", "entity_error_rate_10m", H_RATE, 10),
    ("report_latency", "entity_avg_latency_ms_5m", H_LATENCY, 5),
):
    ORACLES[_name] = with_(HISTORY) + _baseline(_feature_name, _value, _minutes, _RUN_1) + _NEWEST

# --- parity and measurements ------------------------------------------------------------------------------

COMPARED = (
    HISTORY,
    """la AS (SELECT * FROM (SELECT *,
        event_time + to_minutes(cast(l_orderkey % 13 AS int)) AS arrival_time FROM l)
      WHERE event_time >= arrival_time - INTERVAL 10 MINUTE)""",
    built_in_features("la"),
    f"y AS ({_TOTAL} UNION ALL {_COUNT} UNION ALL {_RATE} UNION ALL {_LATENCY})",
    """cp AS (
  SELECT coalesce(f.entity_type, y.entity_type) AS entity_type,
         coalesce(f.entity_id, y.entity_id) AS entity_id,
         coalesce(f.feature_name, y.feature_name) AS feature_name,
         coalesce(f.window_start, y.window_start) AS window_start,
         f.value AS realtime_value, y.value AS baseline_value,
         CASE WHEN f.value IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS realtime_status,
         CASE WHEN y.value IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS baseline_status,
         CASE WHEN f.value IS NULL OR y.value IS NULL THEN 'unavailable'
              WHEN abs(f.value - y.value) <= 0.000001 THEN 'match' ELSE 'mismatch' END AS verdict
  FROM f FULL JOIN y ON f.entity_id = y.entity_id AND f.entity_type = y.entity_type
    AND f.feature_name = y.feature_name
    AND coalesce(f.window_start, TIMESTAMP '1900-01-01')
      = coalesce(y.window_start, TIMESTAMP '1900-01-01'))""",
)

ORACLES["parity_summary"] = with_(*COMPARED) + """
SELECT feature_name, count(*) AS samples, count(*) FILTER (WHERE verdict = 'match') AS matches,
       count(*) FILTER (WHERE verdict = 'mismatch') AS mismatches,
       count(*) FILTER (WHERE verdict = 'unavailable') AS unavailable
FROM cp GROUP BY 1"""

ORACLES["parity_examples"] = with_(*COMPARED) + """
SELECT entity_type, entity_id, feature_name, window_start, realtime_value, baseline_value,
       realtime_status, baseline_status, verdict
FROM cp WHERE verdict = 'mismatch'
ORDER BY feature_name, entity_type, entity_id, window_start LIMIT 10"""

LATENCY_FIGURES = """round(avg(latency_ms), 6) AS avg_ms, min(latency_ms) AS min_ms,
       quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
       quantile_disc(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms"""

OPERATION_FIGURES = """count(*) AS total, count(*) FILTER (WHERE success) AS successes,
       count(*) FILTER (WHERE NOT success) AS failures,
       round(count(*) FILTER (WHERE NOT success) / count(*), 6) AS error_rate,
       count(*) FILTER (WHERE status_code NOT BETWEEN 200 AND 299) AS http_non_2xx,
       count(*) FILTER (WHERE timeout) AS timeouts"""

ORACLES["latency_summary"] = with_(MEASURED) + f"""
SELECT type, count(*) AS count, {LATENCY_FIGURES} FROM m GROUP BY 1"""

ORACLES["operation_summary"] = with_(MEASURED) + f"""
SELECT type, {OPERATION_FIGURES} FROM m GROUP BY 1"""

ORACLES["status_counts"] = with_(MEASURED) + """
SELECT phase, feature_status, count(*) AS operations
FROM m WHERE feature_status IS NOT NULL GROUP BY 1, 2"""

ORACLES["phase_summary"] = with_(MEASURED) + f"""
SELECT phase, type, {OPERATION_FIGURES}, {LATENCY_FIGURES},
       count(*) FILTER (WHERE feature_status = 'PRESENT') AS present,
       count(*) FILTER (WHERE feature_status = 'STALE') AS stale,
       count(*) FILTER (WHERE feature_status = 'MISSING') AS missing,
       count(*) FILTER (WHERE feature_status = 'UNAVAILABLE') AS unavailable
FROM m GROUP BY 1, 2"""

ORACLES["slo_summary"] = with_(
    MEASURED,
    """e AS (SELECT phase, (max(epoch_us(started_at) + latency_ms * 1000)
                 - min(epoch_us(started_at))) / 1000000 AS elapsed FROM m GROUP BY 1),
  c AS (SELECT phase, type,
          CASE WHEN type = 'event_publish' THEN count(*) FILTER (WHERE success)
               ELSE count(*) END AS completed,
          quantile_disc(latency_ms, 0.95) AS p95,
          cast(floor(CASE WHEN phase = 'warmup' THEN 0.00001::double ELSE 0.001::double END
               * 2592000) AS bigint) AS target
        FROM m GROUP BY 1, 2)""",
) + """
SELECT c.phase, type, target AS target_operations, completed AS completed_operations,
       round(completed / elapsed, 6) AS completed_per_second,
       completed >= target AND p95 <= 2500 AS sustained
FROM c JOIN e ON c.phase = e.phase"""

ORACLES["availability_latency"] = with_(USER) + """
, p AS (SELECT entity_id, event_id AS probe_id, event_time AS started_at, arrival_time AS ack_at
        FROM u WHERE event_type = 'purchase'),
  c AS (SELECT entity_id, arrival_time AS updated_at FROM u
        WHERE event_type = 'click' AND value > 0),
  v AS (SELECT p.entity_id, p.probe_id, p.ack_at, min(c.updated_at) AS seen
        FROM p LEFT JOIN c ON c.entity_id = p.entity_id AND c.updated_at >= p.started_at
          AND c.updated_at <= p.ack_at + INTERVAL 6 HOUR
        GROUP BY 1, 2, 3)
SELECT entity_id, probe_id,
       CASE WHEN seen IS NOT NULL THEN greatest(0,
         cast(floor((epoch_us(seen) - epoch_us(ack_at)) / 1000) AS bigint)) END AS latency_ms,
       seen IS NULL AS timed_out
FROM v"""

ORACLES["expected_values"] = with_(LOG) + """
SELECT entity_id, count(*) AS events_produced, cast(sum(cnt) AS bigint) AS expected_total,
       round(sum(CASE WHEN coalesce(status, 200) >= 500 THEN cnt ELSE 0 END) / sum(cnt), 6)
         AS expected_error_rate,
       round(sum(cnt * coalesce(lat, 100)) / sum(cnt), 6) AS expected_average_latency_ms
FROM l GROUP BY 1"""

ORACLES["raw_rows"] = with_(MEASURED) + """
SELECT * FROM m ORDER BY started_at, event_id LIMIT 1000"""

# --- monitoring ---------------------------------------------------------------------------------------------

ORACLES["outcome_counts"] = with_(OUTCOMES) + """
SELECT count(*) AS received, count(*) FILTER (WHERE outcome = 'processed') AS processed,
       count(*) FILTER (WHERE outcome = 'invalid') AS invalid,
       count(*) FILTER (WHERE outcome = 'ignored') AS ignored,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate,
       count(*) FILTER (WHERE outcome = 'late') AS late,
       count(*) FILTER (WHERE late_accepted) AS late_accepted,
       count(*) FILTER (WHERE outcome = 'late') AS late_rejected
FROM oc"""

ORACLES["outcome_rates"] = with_(OUTCOMES) + f"""
SELECT {bucket(5, "arrival_time")} AS window_start,
       round(count(*) / 300, 6) AS received_per_second,
       round(count(*) FILTER (WHERE outcome = 'processed') / 300, 6) AS processed_per_second,
       round(count(*) FILTER (WHERE outcome = 'invalid') / 300, 6) AS invalid_per_second,
       round(count(*) FILTER (WHERE outcome = 'duplicate') / 300, 6) AS duplicate_per_second,
       round(count(*) FILTER (WHERE outcome = 'late') / 300, 6) AS late_per_second,
       round(count(*) FILTER (WHERE late_accepted) / 300, 6) AS late_accepted_per_second
FROM oc GROUP BY 1"""

ORACLES["lag_quantiles"] = with_(OUTCOMES) + """
SELECT timing, quantile_disc(lag_ms, 0.5) AS p50, quantile_disc(lag_ms, 0.95) AS p95,
       quantile_disc(lag_ms, 0.99) AS p99
FROM oc WHERE lag_ms IS NOT NULL GROUP BY 1"""

ORACLES["freshness_quantiles"] = with_(
    STORED,
    """q AS (SELECT kind, greatest(0,
         cast(floor((epoch_us(now) - epoch_us(updated_at)) / 1000) AS bigint) - 120000) AS ms
       FROM st WHERE updated_at IS NOT NULL)""",
) + """
SELECT kind, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95,
       quantile_disc(ms, 0.99) AS p99
FROM q GROUP BY 1"""

ORACLES["read_status_counts"] = with_(STORED) + """
SELECT lower(status) AS status, count(*) AS reads FROM st GROUP BY 1"""

ORACLES["state_size"] = with_(
    LOG,
    f"""i AS (
  SELECT entity_id, 'request_count_total' AS name, NULL AS w,
         cast(cast(sum(cnt) AS bigint) AS varchar) AS state FROM l GROUP BY 1
  UNION ALL
  SELECT entity_id, 'entity_event_count_10m', {bucket(10)}, cast(count(*) AS varchar)
  FROM l GROUP BY 1, 3
  UNION ALL
  SELECT entity_id, 'entity_error_rate_10m', {bucket(10)},
         cast(sum(CASE WHEN status >= 500 THEN cnt ELSE 0 END) AS bigint) || ','
         || cast(sum(cnt) AS bigint)
  FROM l WHERE status IS NOT NULL GROUP BY 1, 3
  UNION ALL
  SELECT entity_id, 'entity_avg_latency_ms_5m', {bucket(5)},
         cast(sum(lat * cnt) AS bigint) || ',' || cast(sum(cnt) AS bigint)
  FROM l WHERE lat IS NOT NULL GROUP BY 1, 3)""",
) + """
SELECT count(*) AS entries,
       cast(sum(strlen('feature:service:' || entity_id || ':' || name
         || CASE WHEN w IS NULL THEN '' ELSE ':window:' || epoch_ms(w) END)) AS bigint)
         AS key_bytes,
       cast(sum(strlen(state)) AS bigint) AS value_bytes
FROM i"""

# --- declarations as rows -----------------------------------------------------------------------

ORACLES["declared_matches"] = ORACLES["match_definitions"]
ORACLES["declared_features"] = with_(USER) + f"""
SELECT entity_type, entity_id, event_type || '_over_' || cast(10 * i AS varchar) AS feature_name,
       CASE WHEN i % 4 = 1 THEN {bucket(7 * 1440)} END AS window_start,
       cast(round(CASE WHEN i % 2 = 1 THEN count(*) ELSE sum(value) END, 6) AS double) AS value,
       count(*) AS n
FROM u, range(20) t(i) WHERE value > 10 * i GROUP BY entity_type, entity_id, event_type, i, 4"""
