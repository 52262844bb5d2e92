import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tidemark.definitions import BUILT_IN_FEATURES
from tidemark.operators import dedup
from tidemark.operators.outcomes import event_outcomes
from tidemark.sources.events import decode_events, encode_events

NOW = dt.datetime(2026, 8, 28, 12, 10, 14, 200_000)
VALID = (
    '{"eventId": "%s", "eventType": "request.completed", "eventTime": "%s", '
    '"entity": {"type": "service", "id": "catalog-api"}, "payload": %s}'
)
AT = "2026-08-28T12:10:14.200Z"


def message(event_id="e", at=AT, payload='{"count": 100}'):
    return VALID % (event_id, at, payload)


def outcomes(spark, texts, now=NOW):
    rows = [("platform.events-0", i, now, text) for i, text in enumerate(texts)]
    raw = spark.createDataFrame(
        rows, "namespace string, seq bigint, arrival_time timestamp, value string"
    )
    done = event_outcomes(decode_events(raw), BUILT_IN_FEATURES)
    return [(r.outcome, r.reason) for r in done.orderBy("seq").collect()]


CASES = [
    (message(), ("processed", None)),
    (message(payload='{"count":1,"statusCode":500,"latencyMs":300}'), ("processed", None)),
    ('{"eventId": "e", "eventType": "x"}', ("invalid", "entity_not_object")),
    ("not json", ("invalid", "malformed_json")),
    ('{"eventId": "e"', ("invalid", "malformed_json")),
    (None, ("invalid", "malformed_json")),
    (message(payload="[1]"), ("invalid", "payload_not_object")),
    (message(payload='{"count": "100"}'), ("invalid", "count_not_numeric")),
    (message(payload="{}"), ("invalid", "count_missing")),
    (message(payload='{"count": -1}'), ("invalid", "count_negative")),
    (message(payload='{"count": 99.9}'), ("processed", None)),
    (message(payload='{"count": 1, "statusCode": 99}'), ("invalid", "status_out_of_range")),
    (message(payload='{"count": 1, "statusCode": 100}'), ("processed", None)),
    (message(payload='{"count": 1, "statusCode": 599}'), ("processed", None)),
    (message(payload='{"count": 1, "statusCode": 600}'), ("invalid", "status_out_of_range")),
    (message(payload='{"count": 1, "latencyMs": -1}'), ("invalid", "latency_negative")),
    (message(payload='{"count": 1, "count": 2}'), ("processed", None)),
    (message(payload='{"count": 1, "x": null}'), ("processed", None)),
    (message(at="2026-08-28T12:20:14.200Z"), ("invalid", "future_event")),
    (message(at="2026-08-28T12:15:14.200Z"), ("processed", None)),
    (message(at="2026-08-28"), ("invalid", "unparsable_event_time")),
    (message(at="soon"), ("invalid", "unparsable_event_time")),
    (message(at="2026-08-28T12:00:14.200Z"), ("processed", None)),
    (message(at="2026-08-28T12:00:14.199Z"), ("late", None)),
    (message().replace("request.completed", " "), ("invalid", "bad_event_type")),
    (message().replace("request.completed", "auth.failed"), ("ignored", None)),
    (message().replace("catalog-api", "a:b"), ("invalid", "bad_key")),
]


def test_messages(spark):
    texts = [t and t.replace('"eventId": "e"', f'"eventId": "e{i}"') for i, (t, _) in enumerate(CASES)]
    for got, (text, want) in zip(outcomes(spark, texts), CASES, strict=True):
        assert got == want, text


def test_burst_of_copies(spark):
    got = outcomes(spark, [message()] * 100)
    assert [o for o, _ in got] == ["processed"] + ["duplicate"] * 99


def test_failed_event_leaves_no_marker_and_meets_one(spark):
    bad = message().replace("catalog-api", "a:b")
    assert [o for o, _ in outcomes(spark, [bad, message(), bad])] == [
        "invalid",
        "processed",
        "duplicate",
    ]


def test_encode_decode_round_trip(spark):
    raw = spark.createDataFrame([(message(payload='{"count": 7.9, "z": {"a": [1]}}'),)], "value string")
    event = decode_events(raw)
    text = event.select(encode_events(event).alias("j")).first().j
    assert text == (
        '{"eventId":"e","eventType":"request.completed","eventTime":"2026-08-28T12:10:14.200Z",'
        '"entity":{"type":"service","id":"catalog-api"},"payload":{"count":7,"z":{"a":[1]}}}'
    )


HOUR = 3_600_000


def arrivals(spark, rows):
    frame = spark.createDataFrame(rows, "namespace string, event_id string, ms bigint, seq bigint")
    return frame.withColumn("arrival_time", F.timestamp_millis("ms")).drop("ms")


def sequential(rows, retention):
    """The markers a worker sets that sees the arrivals one by one."""
    expiry, taken = {}, set()
    for ns, event_id, ms, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        if ms >= expiry.get((ns, event_id), -(2**62)):
            expiry[ns, event_id] = ms + retention
            taken.add((ns, event_id, ms, seq))
    return taken


def test_retention_chain(spark):
    rows = [("p-0", "e", h * HOUR, i) for i, h in enumerate((0, 5, 23, 24, 30, 47, 48, 100))]
    rows.append(("p-1", "e", 5 * HOUR, 99))
    taken = dedup.markers(arrivals(spark, rows), 24 * HOUR)
    got = sorted((r.namespace, r.marker_ms // HOUR) for r in taken.collect())
    assert got == [("p-0", 0), ("p-0", 24), ("p-0", 48), ("p-0", 100), ("p-1", 5)]


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_markers_and_labels_against_a_sequential_worker(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 12 + [f"k{i}" for i in range(8)]
    rows = [
        (f"p-{rng.randrange(2)}", rng.choice(keys), rng.randrange(-50, 90), seq)
        for seq in range(600)
    ]
    frame = arrivals(spark, rows)
    taken = dedup.markers(frame, 20)
    want = sequential(rows, 20)
    assert {tuple(r) for r in taken.collect()} == want
    labelled = dedup.label(frame, taken, 20).collect()
    assert len(labelled) == len(rows)
    for r in labelled:
        is_marker = (r.namespace, r.event_id, rows[r.seq][2], r.seq) in want
        assert (r.is_taken, r.is_duplicate) == (is_marker, not is_marker)


def test_sparse_and_touching_arrivals_against_a_sequential_worker(spark):
    """Gaps of exactly the retention, one less and one more; empty cells; stretches of all lengths."""
    rng = random.Random(3)
    rows, seq = [], 0
    for key in range(30):
        at = rng.randrange(-200, 200)
        for _ in range(rng.randrange(1, 40)):
            rows.append(("p-0", f"k{key}", at, seq))
            at, seq = at + rng.choice([0, 1, 5, 9, 10, 10, 11, 19, 20, 21, 35]), seq + 1
    taken = {tuple(r) for r in dedup.markers(arrivals(spark, rows), 10).collect()}
    assert taken == sequential(rows, 10)


def test_a_chain_of_a_thousand_retentions_takes_few_rounds(spark, monkeypatch):
    rows = [("p-0", "hot", 6 * i, i) for i in range(2 * 1000)]  # a marker covers two of them
    asked = []
    is_empty = DataFrame.isEmpty
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: asked.append(1) or is_empty(self))
    taken = {tuple(r) for r in dedup.markers(arrivals(spark, rows), 12).collect()}
    assert taken == sequential(rows, 12) and len(taken) == 1000
    assert len(asked) - 1 <= 12


def test_expired_markers_are_not_live(spark):
    now = dt.datetime(2026, 8, 28, 12, 20)
    rows = spark.createDataFrame(
        [("platform.events-0", "event-1", now, 0)],
        "namespace string, event_id string, arrival_time timestamp, seq bigint",
    )
    taken = dedup.markers(rows)
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    assert dedup.live_markers(taken, at(1788005999999)).count() == 1
    assert dedup.live_markers(taken, at(1788006000000)).count() == 0
