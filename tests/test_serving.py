import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.definitions import BUILT_IN_FEATURES, FeatureDefinition
from tidemark.functions.keys import feature_key, parse_key
from tidemark.functions.values import number_text, parse_value
from tidemark.operators import serving
from tidemark.sources import registry

NOW = dt.datetime(2026, 8, 28, 12, 20)
TEN = dt.datetime(2026, 8, 28, 12, 10)


def read(spark, stored, asked, **options):
    rows = [
        ("service", entity, name, start, text, at, version, None)
        for entity, name, start, text, at, version in stored
    ]
    table = spark.createDataFrame(rows, schemas.SERVING)
    lookups = spark.createDataFrame(
        [(i, "service", *ask) for i, ask in enumerate(asked)], schemas.LOOKUPS
    )
    return (
        serving.read_features(lookups, table, F.lit(NOW), **options).orderBy("pos").collect()
    )


def test_reads(spark):
    minute = lambda m: dt.datetime(2026, 8, 28, 12, m)
    stored = [
        ("catalog", "request_count_total", None, "450", minute(19), 1),
        ("checkout", "request_count_total", None, "0", minute(15), None),
        ("old", "request_count_total", None, "7", minute(0), 3),
        ("broken", "request_count_total", None, "abc", minute(19), 1),
        ("undated", "request_count_total", None, "1", None, 1),
        ("catalog", "entity_error_rate_10m", TEN, "0.25", minute(19), 1),
    ]
    asked = [
        ("catalog", "request_count_total", None),
        ("checkout", "request_count_total", None),
        ("none", "request_count_total", None),
        ("old", "request_count_total", None),
        ("broken", "request_count_total", None),
        ("undated", "request_count_total", None),
        ("catalog", "entity_error_rate_10m", TEN),
        ("catalog", "entity_error_rate_10m", None),
        ("none", "nothing", None),
    ]
    table = registry.registry_table(spark, BUILT_IN_FEATURES)
    got = read(spark, stored, asked, registry=table)
    assert [(r.value, r.status, r.freshness_ms, r.definition_version) for r in got] == [
        (450.0, "PRESENT", 60_000, 1),
        (0.0, "PRESENT", 300_000, 1),
        (None, "MISSING", None, 1),
        (7.0, "STALE", 1_200_000, 3),
        (None, "UNAVAILABLE", None, 1),
        (1.0, "PRESENT", None, 1),
        (0.25, "PRESENT", 60_000, 1),
        (None, "MISSING", None, 1),
        (None, "MISSING", None, None),
    ]


def test_latest_row_follows_the_newest_window(spark):
    d = FeatureDefinition("f", "e", "COUNT", window_type="TUMBLING", window="10m")
    windows = [(TEN, 5.0, 1), (TEN + dt.timedelta(minutes=10), 2.0, 1), (TEN, 9.0, 2)]
    rows = [
        ("service", "a", "f", version, start, value, 1, value, 0.0, NOW, NOW)
        for start, value, version in windows
    ]
    table = serving.serving_rows(spark.createDataFrame(rows, schemas.FEATURE_ROWS), [d])
    latest = table.where("window_start is null").collect()
    assert [(r.value_text, r.definition_version, r.expires_at) for r in latest] == [("2", 1, None)]
    assert table.where("window_start is not null").count() == 2


def test_key_text(spark):
    key = "feature:service:catalog-api:entity_event_count_10m:window:1787919000000"
    parts = [F.lit(p) for p in ("service", "catalog-api", "entity_event_count_10m")]
    made, bad, back, plain, none = spark.range(1).select(
        feature_key(*parts, F.lit(TEN)),
        feature_key(F.lit("service"), F.lit("a:b"), F.lit("f")),
        parse_key(F.lit(key)).window_start,
        parse_key(F.lit("feature:a:b:c")).feature_name,
        parse_key(F.lit("feature:a:b:c:pane:1")).feature_name,
    ).first()
    assert (made, bad, back, plain, none) == (key, None, TEN, "c", None)


def test_value_text(spark):
    shown = {450.0: "450", 80.5: "80.5", 1e10: "10000000000", 2.0**63: str(2**63 - 1), 1e300: "1.0E300"}
    frame = spark.createDataFrame([(v,) for v in shown], "v double")
    got = {r.v: r.t for r in frame.withColumn("t", number_text(F.col("v"))).collect()}
    assert got == shown
    texts = {"450": 450.0, "0.25": 0.25, "1e3": 1000.0, "abc": None, "": None, "1.x": None}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in frame.withColumn("v", parse_value(F.col("t"))).collect()} == texts


def test_registry_lifecycle(spark):
    v1 = FeatureDefinition("f", "e", "COUNT")
    v2 = FeatureDefinition("f", "e", "COUNT", version=2, state="DRAFT")
    table = registry.registry_table(spark, [v1, v2])

    def states(frame):
        return {(r.name, r.version): r.state for r in frame.collect()}

    target = spark.createDataFrame([("f", 2), ("g", 1)], "name string, version int")
    active = registry.activate(table, target)
    assert states(active) == {("f", 1): "INACTIVE", ("f", 2): "ACTIVE"}
    assert registry.unknown_targets(table, target).count() == 1
    assert states(registry.deactivate(active, target))[("f", 2)] == "INACTIVE"
    resaved = registry.registry_table(spark, [v2.with_state("ACTIVE")])
    saves = resaved.withColumn("save_seq", F.lit(1))
    assert states(registry.upsert(table, saves)) == {("f", 1): "INACTIVE", ("f", 2): "ACTIVE"}
    assert states(registry.save_drafts(active, saves))[("f", 2)] == "DRAFT"
    assert registry.load_active(active) == [v2.with_state("ACTIVE")]


def test_computed_reads_equal_reads_of_the_whole_table(spark):
    """Unasked declarations still refuse events; unasked features, kinds and entities are not computed."""
    from conftest import SMALL
    from tidemark.plans.features import compute_features
    from tidemark.workload import views

    events = views.user_events(spark, SMALL)
    events = views.variant_events(
        events,
        F.concat(F.lit('{"value": '), F.when(F.col("seq") % 3 == 0, F.lit('"x"')).otherwise(F.lit("7")), F.lit(', "k": 2}')),
    )
    now = views.instant("2024-01-12 00:00:00")
    table = serving.serving_rows(compute_features(events, views.USER_FEATURES), views.USER_FEATURES)
    asks = {
        "mixed": [("user", f"u-{i}", n, None) for i in range(5) for n in ("avg_value_1d", "purchase_value_total", "none")]
        + [("user", f"u-{i}", "click_count_10m", dt.datetime(2024, 1, 11, 23, 50)) for i in range(5)],
        "windows": [("user", f"u-{i}", "avg_value_1d", dt.datetime(2024, 1, d)) for i in range(20) for d in (3, 11, 12)],
        "unknown": [("user", "u-1", "none", None)],
    }
    for kind, rows in asks.items():
        lookups = spark.createDataFrame(rows, "entity_type string, entity_id string, feature_name string, window_start timestamp")
        want = serving.read_features(lookups, table, now).collect()
        read = serving.read_computed(lookups, events, views.USER_FEATURES, now)
        assert sorted(map(str, read.collect())) == sorted(map(str, want)), kind
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "click_count_1h_15m" not in plan
