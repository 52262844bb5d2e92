"""What moves between tasks, and what one task holds."""

import datetime as dt

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition
from tidemark.operators import baseline, parity
from tidemark.plans import features
from tidemark.workload import views
from tidemark.workload.queries import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", ["exists", "eq", "ne", "gt", "gte", "lt", "lte"])
def test_filters_hold_no_table_in_every_task(spark, operator):
    assert "Broadcast" not in plan_of(QUERIES[f"filter_{operator}"](spark, SMALL))


def test_windows_are_made_after_the_last_shuffle_of_panes(spark):
    plan = plan_of(QUERIES["busiest_sliding"](spark, SMALL))
    # Panes, panes by stretch, sums by value, sums by user; no window is sorted for an aggregate.
    assert plan.count("Exchange hashpartitioning") == 4
    assert not any("start_ms" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "stretch" in line)


def test_many_windows_to_a_pane_as_few(spark, monkeypatch):
    events = views.user_events(spark, SMALL).where("seq % 3 < 2")
    slides = [("3h", "7m"), ("1h", "4m"), ("50m", "1m")]
    definitions = [*views.USER_FEATURES] + [
        FeatureDefinition(f"{kind}-{size}", "click", kind, "user", value_field="k", window_type="SLIDING", window=size, slide=slide)
        for size, slide in slides
        for kind in ("SUM", "AVG", "DISTINCT_COUNT")
    ]
    columns = [*features.FEATURE_KEYS, F.round("value", 6).alias("value"), "n", "updated_at", "expires_at"]

    def rows():
        return sorted(map(str, features.compute_features(events, definitions).select(*columns).collect()))

    found = rows()
    monkeypatch.setattr(features, "SPREAD", 10**9)
    assert found == rows() != []


def sides(spark):
    at = dt.datetime(2024, 1, 1)
    schema = "entity_type string, entity_id string, feature_name string, window_start timestamp, value double"
    realtime = [("s", "a", "x", at, 1.0), ("s", "a", "y", at, 2.0), ("s", "a", "other", at, 3.0), (None, None, None, None, None)]
    computed = [("s", "a", "x", at, 1.0), ("s", "a", "y", None, 2.0), ("s", "a", "other", at, 4.0), ("s", "b", "x", at, None)]
    return spark.createDataFrame(realtime, schema), spark.createDataFrame(computed, schema)


def test_expected_features_compare_as_any(spark):
    plain = sorted(map(str, parity.compare(*sides(spark)).collect()))
    assert sorted(map(str, parity.compare(*sides(spark), ["x", "y", "z"]).collect())) == plain
    assert len(plain) == 6


def test_baseline_windows_take_one_shuffle_each_way(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 4, 5, 9, 10, 25)] + [None]
    rows = [("service", "a", t, n, 500 if n % 2 else 200, 7 * n) for n, t in enumerate(at)]
    history = spark.createDataFrame(
        rows, "entity_type string, entity_id string, event_time timestamp, count_value long, status_code int, latency_ms long"
    )
    found = baseline.all_windows(history)
    # One for the windows, one for the totals.
    assert plan_of(found).count("Exchange hashpartitioning") == 2
    single = [baseline.windows(history, f) for f in baseline.WINDOW_MS] + [baseline.totals(history)]
    want = [r for frame in single for r in frame.collect()]
    assert sorted(map(str, found.collect())) == sorted(map(str, want))
