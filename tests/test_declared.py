"""Declarations as rows against the compiled form."""

import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.definitions import FeatureDefinition, FieldFilter
from tidemark.plans import declared, features
from tidemark.sources.registry import registry_table
from tidemark.workload import views

OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")
FIELDS = ("value", "payload.k", "deep.text", "deep", "list", "flag", "gone", "eventId", "entity.id", "eventType")
LITERALS = ("3", "7.5", "abc", "u-3", "true", "click", "1e0")


def awkward_events(spark):
    events = views.user_events(spark, SMALL)
    n = F.col("seq")
    value = F.when(n % 11 == 0, F.lit("null")).when(n % 13 == 0, F.lit('"abc"')).otherwise((n % 9).cast("string"))
    body = F.concat(
        F.lit('{"value": '), value, F.lit(', "k": '), F.when(n % 5 == 0, F.lit("7.5")).otherwise(F.lit("3")),
        F.lit(', "deep": {"text": "abc", "n": 3}, "list": [1, 2], "flag": true}'),
    )
    rows = views.variant_events(events, body)
    entity = F.when(n % 17 == 0, F.struct(F.lit("user").alias("type"), F.lit("a:b").alias("id"))).otherwise(F.col("entity"))
    return rows.withColumn("entity", entity)


def same(spark, events, definitions):
    table = registry_table(spark, definitions)
    columns = [*features.FEATURE_KEYS, F.round("value", 6).alias("value"), "n", "updated_at", "expires_at"]
    got = declared.compute_declared(events, table).select(*columns)
    want = features.compute_features(events, definitions).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    pairs = ["event_id", "feature_name", "definition_version"]
    got = declared.match_declared(events, table).select(*pairs).collect()
    assert sorted(got) == sorted(features.match_definitions(events, definitions).select(*pairs).collect())


def test_every_filter_matches_as_compiled(spark):
    events = awkward_events(spark).where("seq < 120")
    definitions = [
        FeatureDefinition(f"{f}-{o}-{v}", "click", "COUNT", filter=FieldFilter(f, o, v))
        for f in FIELDS for o in OPERATORS for v in LITERALS
    ] + [FeatureDefinition(f"{f}-exists", "click", "COUNT", filter=FieldFilter(f, "EXISTS")) for f in FIELDS]
    table = registry_table(spark, definitions)
    columns = ["event_id", "supported", F.col("failure").isNotNull()]
    judged = declared.evaluate(events, table)
    found = {(r.event_id, name) for r in judged.select("event_id", "matched.feature_name").collect() for name in r.feature_name}
    got = sorted(judged.select(*columns).collect())
    assert got == sorted(features.with_failure(events, definitions).select(*columns).collect())
    compiled = features.match_definitions(events, definitions).select("event_id", "feature_name").collect()
    assert found == {tuple(r) for r in compiled}


@pytest.mark.parametrize("typed", [True, False])
def test_all_aggregations_and_windows_as_compiled(spark, typed):
    events = views.user_events(spark, SMALL) if typed else awkward_events(spark)
    uneven = dict(window_type="SLIDING", window="10m", slide="4m")
    extra = [
        FeatureDefinition("uneven", "click", "SUM", value_field="k", **uneven),
        FeatureDefinition("uneven_distinct", "click", "DISTINCT_COUNT", value_field="k", **uneven),
        FeatureDefinition("elsewhere", "click", "COUNT", "service"),
        FeatureDefinition("draft", "click", "COUNT", state="DRAFT"),
    ]
    same(spark, events, [*views.USER_FEATURES, *extra])


def test_refused_events_as_compiled(spark):
    events = awkward_events(spark)
    table = registry_table(spark, views.USER_FEATURES)
    columns = ["event_id", "supported", F.col("failure").isNull().alias("fine")]
    got = declared.evaluate(events, table).select(*columns).collect()
    assert sorted(got) == sorted(features.with_failure(events, views.USER_FEATURES).select(*columns).collect())
    reasons = {r.failure for r in declared.evaluate(events, table).select("failure").distinct().collect()}
    assert {"bad_key", "missing value", "value is not a number"} <= reasons


def test_planning_takes_no_longer_for_more_declarations(spark):
    events = views.user_events(spark, SMALL)

    def seconds(definitions):
        table = registry_table(spark, definitions)
        began = time.monotonic()
        plan = declared.compute_declared(events, table)._jdf.queryExecution().executedPlan().toString()
        return time.monotonic() - began, plan.count("\n")

    seconds(views.THRESHOLD_FEATURES[:1])
    few, many = seconds(views.THRESHOLD_FEATURES[:2]), seconds(views.THRESHOLD_FEATURES * 1)
    assert few[1] == many[1]
    assert many[0] < 10


def test_no_declarations(spark):
    events = views.user_events(spark, SMALL)
    table = registry_table(spark, views.USER_FEATURES).where("false")
    assert declared.compute_declared(events, table).count() == 0
    assert declared.evaluate(events, table).where("supported or failure is not null").count() == 0


def test_a_path_is_read_once_however_many_declarations_name_it(spark):
    events = awkward_events(spark).where("event_type = 'click' and seq < 120")

    def reads(definitions):
        table = registry_table(spark, definitions)
        row = declared._declared_types(table).where("_type = 'click'").first()
        return row["_paths"], len(row["_declared"])

    definitions = [d for d in views.THRESHOLD_FEATURES if d.event_type == "click"]
    assert reads(definitions) == (["value", None], 20)
    # What is judged is not copied into later steps: each stands in the plan once.
    plan = declared.compute_declared(events, registry_table(spark, definitions))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("missing ") <= 2
