import datetime as dt
import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.definitions import BUILT_IN_FEATURES, FeatureDefinition, FieldFilter
from tidemark.functions.fields import resolver
from tidemark.functions.filters import compile_filter
from tidemark.functions.windows import sliding_starts
from tidemark.plans.features import (
    compute_features,
    distinct_sketches,
    finish_sketches,
    group_definitions,
    merge_sketches,
    with_failure,
)

EVENT = (
    "event_id string, event_type string, event_time timestamp, "
    "entity struct<type: string, id: string>, body string, arrival_time timestamp"
)


def events(spark, bodies, at="2026-08-28 12:14:59.999", kind="request.completed", entity=None):
    when = dt.datetime.fromisoformat(at)
    entity = entity or ("service", "catalog-api")
    rows = [(str(i), kind, when, entity, b, when) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, EVENT)
    return frame.withColumn("payload", F.parse_json("body")).drop("body")


SAMPLES = [
    '{"count": 100, "statusCode": 200, "latencyMs": 80}',
    '{"count": 300, "statusCode": 200, "latencyMs": 120}',
    '{"count": 50, "statusCode": 500, "latencyMs": 300}',
]


def values(frame):
    return {(r.feature_name, r.window_start): r.value for r in frame.collect()}


@pytest.mark.parametrize("max_slots", [1, 8])
def test_golden_samples(spark, max_slots):
    got = values(compute_features(events(spark, SAMPLES), BUILT_IN_FEATURES, max_slots=max_slots))
    ten, five = dt.datetime(2026, 8, 28, 12, 10), dt.datetime(2026, 8, 28, 12, 10)
    assert got == {
        ("request_count_total", None): 450.0,
        ("entity_event_count_10m", ten): 3.0,
        ("entity_error_rate_10m", ten): 50 / 450,
        ("entity_avg_latency_ms_5m", five): 59000 / 450,
    }


def test_groups_share_windows():
    groups = group_definitions(BUILT_IN_FEATURES)
    assert sorted(len(g.members) for g in groups) == [1, 1, 2]


def one(spark, bodies, **definition):
    d = FeatureDefinition("f", "e", **definition)
    rows = compute_features(events(spark, bodies, kind="e"), [d]).collect()
    return rows[0].value if rows else None


def test_aggregations(spark):
    v = '{{"v": {}, "w": {}, "u": "{}"}}'.format
    assert one(spark, [v(1, 1, "a")] * 2, aggregation="COUNT") == 2
    assert one(spark, [v(80, 0, "a"), v(120, 0, "a")], aggregation="AVG", value_field="v") == 100
    weighted = dict(aggregation="AVG", value_field="v", weight_field="w")
    assert one(spark, [v(80, 100, "a"), v(120, 300, "a")], **weighted) == 110
    assert one(spark, [v(80, 0, "a")], **weighted) == 0.0
    users = [v(1, 1, "u-1"), v(1, 1, "u-1"), v(1, 1, "u-2"), v(1, 1, "")]
    assert one(spark, users, aggregation="DISTINCT_COUNT", value_field="u") == 3
    ratio = dict(
        aggregation="RATIO", value_field="v", numerator_filter=FieldFilter("w", "GTE", "500")
    )
    assert one(spark, [v(400, 200, "a"), v(50, 500, "a")], **ratio) == 50 / 450
    assert one(spark, [v(0, 500, "a")], **ratio) == 0.0


def test_unusable_events_add_nothing_anywhere(spark):
    total = FeatureDefinition("total", "e", "SUM", value_field="v")
    count = FeatureDefinition("count", "e", "COUNT")
    frame = events(spark, ['{"v": 1}', '{"v": "2"}', '{"v": null}', "{}"], kind="e")
    assert values(compute_features(frame, [total, count])) == {
        ("total", None): 1.0,
        ("count", None): 1.0,
    }
    reasons = [r.failure for r in with_failure(frame, [total, count]).orderBy("event_id").collect()]
    assert reasons == [None, "v is not a number", "missing v", "missing v"]
    colon = events(spark, ['{"v": 1}'], kind="e", entity=("service", "a:b"))
    assert with_failure(colon, [total]).first().failure == "bad_key"
    other = events(spark, ['{"v": 1}'], kind="other", entity=("service", "a:b"))
    assert with_failure(other, [total]).first().failure is None


def test_scope_and_versions(spark):
    scoped = [
        FeatureDefinition("all", "e", "COUNT"),
        FeatureDefinition("mine", "e", "COUNT", "service"),
        FeatureDefinition("other", "e", "COUNT", "user"),
        FeatureDefinition("draft", "e", "COUNT", state="DRAFT"),
    ]
    got = values(compute_features(events(spark, ["{}"], kind="e"), scoped))
    assert set(got) == {("all", None), ("mine", None)}


@pytest.mark.parametrize(
    "op, literal, expected",
    [
        ("EQ", "5", [True, False, False, False]),
        ("NE", "5", [False, True, True, False]),
        ("GT", "5", [False, True, True, False]),
        ("LTE", "5.0", [True, False, False, False]),
        ("EXISTS", None, [True, True, True, False]),
    ],
)
def test_filter_typing(spark, op, literal, expected):
    frame = events(spark, ['{"x": 5}', '{"x": 7.5}', '{"x": "7"}', '{"x": null}'])
    hit = compile_filter(FieldFilter("x", op, literal), resolver(frame.schema)).matches
    assert [r.hit for r in frame.orderBy("event_id").select(hit.alias("hit")).collect()] == expected


def test_number_against_text_literal_is_unusable(spark):
    frame = events(spark, ['{"x": 5}', '{"x": "5"}'])
    compiled = compile_filter(FieldFilter("x", "EQ", "many"), resolver(frame.schema))
    rows = frame.orderBy("event_id").select(compiled.unusable.alias("u")).collect()
    assert [r.u for r in rows] == [True, False]


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.integers(min_value=-(10**12), max_value=4 * 10**12),
    st.integers(min_value=1, max_value=10**7),
    st.integers(min_value=1, max_value=12),
    st.integers(min_value=0, max_value=1000),
)
def test_sliding_windows_against_a_loop(spark, at_ms, slide, times, extra):
    size = slide * times + min(extra, slide - 1)
    start = at_ms - at_ms % slide
    want = []
    while start <= at_ms < start + size:
        want.insert(0, start)
        start -= slide
    at = F.timestamp_millis(F.lit(at_ms))
    got = spark.range(1).select(
        F.transform(sliding_starts(at, size, slide), F.unix_millis).alias("s")
    ).first().s
    assert got == want


def exchanges(frame) -> int:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_one_shuffle_without_distinct_features(spark):
    from conftest import SMALL
    from tidemark.workload import views

    built_in = compute_features(views.request_log(spark, SMALL), BUILT_IN_FEATURES)
    assert exchanges(built_in) == 1
    still = [d for d in views.USER_FEATURES if d.window_type != "SLIDING"]
    with_distinct = compute_features(views.user_events(spark, SMALL), still)
    assert exchanges(with_distinct) == 2
    # Panes to windows is one more.
    assert exchanges(compute_features(views.user_events(spark, SMALL), views.USER_FEATURES)) == 3


@pytest.mark.parametrize(
    "size, slide, names", [(10, 4, "count sum distinct"), (60, 1, "count"), (6, 6, "sum"), (7, 3, "avg distinct")]
)
def test_panes_against_a_loop_over_windows(spark, size, slide, names):
    """Windows from panes as from a walk through every window of every event, also before 1970."""
    rnd = random.Random(size)
    span = {"window_type": "SLIDING", "window": f"{size}m", "slide": f"{slide}m"}
    made = {
        "count": FeatureDefinition("count", "e", "COUNT", **span),
        "sum": FeatureDefinition("sum", "e", "SUM", value_field="v", **span),
        "avg": FeatureDefinition("avg", "e", "AVG", value_field="v", **span),
        "distinct": FeatureDefinition("distinct", "e", "DISTINCT_COUNT", value_field="v", **span),
    }
    definitions = [made[n] for n in names.split()] + [
        FeatureDefinition("day", "e", "COUNT", window_type="TUMBLING", window="1d"),
        FeatureDefinition("ever", "e", "SUM", value_field="v"),
    ]
    epoch = dt.datetime(1970, 1, 1)
    rows = [
        (epoch + dt.timedelta(milliseconds=rnd.randint(-7_200_000, 7_200_000)), f"s{rnd.randint(0, 2)}", rnd.randint(0, 9))
        for _ in range(150)
    ]
    frame = spark.createDataFrame(
        [(str(i), "e", t, ("service", e), f'{{"v": {v}}}', t) for i, (t, e, v) in enumerate(rows)], EVENT
    )
    frame = frame.withColumn("payload", F.parse_json("body")).drop("body").repartition(3)
    want = {}
    for t, e, v in rows:
        minute = (t - epoch) // dt.timedelta(minutes=1)
        for start in range((minute // slide - size // slide - 1) * slide, minute + 1, slide):
            if start <= minute < start + size:
                for n in names.split():
                    want.setdefault((e, n, epoch + dt.timedelta(minutes=start)), []).append(v)
        want.setdefault((e, "day", epoch + dt.timedelta(days=minute // 1440)), []).append(v)
        want.setdefault((e, "ever", None), []).append(v)
    value = {
        "count": len, "day": len, "sum": sum, "ever": sum,
        "avg": lambda x: sum(x) / len(x), "distinct": lambda x: len(set(x)),
    }
    got = {
        (r.entity_id, r.feature_name, r.window_start): (r.value, r.n)
        for r in compute_features(frame, definitions).collect()
    }
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == (pytest.approx(value[key[1]](values)), len(values))


def test_events_are_reduced_before_windows_multiply(spark):
    from conftest import SMALL
    from tidemark.workload import views

    hourly = [views.feature("click_count_1h_15m")]
    plan = compute_features(views.user_events(spark, SMALL), hourly)
    text = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    spread = next(i for i, line in enumerate(text) if "Generate explode" in line and "sequence" in line)
    first = max(i for i, line in enumerate(text) if "Aggregate" in line)
    # Deeper lines come later: the windows are above the first aggregate.
    assert spread < first
    assert not any("sequence" in line for line in text[first:])


def test_scan_reads_only_what_features_need(spark):
    from conftest import SMALL
    from tidemark.workload import views

    clicks = [views.feature("click_count_10m")]
    plan = compute_features(views.user_events(spark, SMALL), clicks)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in text or "In(event_type, [click])" in text
    assert "value" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_sketches_of_many_values(spark):
    """Estimates near the truth, also merged from parts that overlap; the state stays small."""
    visitors = FeatureDefinition(
        "visitors", "visit", "DISTINCT_COUNT", value_field="who", window_type="SLIDING", window="2h", slide="1h"
    )
    events = spark.range(120_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"),
        F.lit("visit").alias("event_type"),
        F.timestamp_millis((F.col("id") % 4) * 1_800_000).alias("event_time"),
        F.struct(F.lit("site").alias("type"), F.lit("s").alias("id")).alias("entity"),
        F.struct(F.concat(F.lit("v"), F.col("id") % 40_000).alias("who")).alias("payload"),
        F.timestamp_millis(F.col("id")).alias("arrival_time"),
    )
    parts = [events.where("event_id < 'e5'"), events.where("event_id > 'e3'")]
    state = merge_sketches(*[distinct_sketches(p, [visitors]) for p in parts])
    assert state.agg(F.max(F.octet_length("sketch"))).first()[0] < 5_000
    got = {r.window_start: r.value for r in finish_sketches(state, [visitors]).collect()}
    want = {r.window_start: r.value for r in compute_features(events, [visitors]).collect()}
    assert got.keys() == want.keys() and len(want) == 3
    for start, value in want.items():
        assert abs(got[start] - value) < 0.065 * value
    with pytest.raises(ValueError):
        distinct_sketches(events, [replace(visitors, aggregation="COUNT")])
