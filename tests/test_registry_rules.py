"""The registry check and the builder agree, and many filtered declarations stay cheap to plan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.definitions import BUILT_IN_FEATURES, FeatureDefinition, FieldFilter
from tidemark.functions.durations import parse_duration
from tidemark.operators import serving
from tidemark.plans.features import compute_features
from tidemark.sources import registry
from tidemark.streaming.snapshot import load_definitions
from tidemark.workload import views

SMALL = "/root/testdata/sf0.001"

TEXTS = """PT0.5S PT1,25S PT-0.5S -PT0.5S P1DT P1D PT PT10M 10m 250ms 0m ten PT1H30M PT0.0001S P1DT2H PT1.5M
    P-1DT25H PT2.123456789S 9223372036854775807d 9223372036854775807ms 9223372036854775808ms
    PT9223372036854775807H PT-9223372036854775808S P106751991167DT99999999999H -P99999999999999999999D
    PT9223372036854775.999S 106751991167d""".split()


def test_durations_agree(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    column = {r[0]: r[1] for r in rows.select("text", registry.duration_millis(F.col("text"))).collect()}
    for text in TEXTS:
        try:
            want = parse_duration(text)
        except ValueError:
            assert column[text] is None or column[text] < 1, text
        else:
            assert column[text] == want, text


def test_any_text_is_judged_alike(spark):
    """No text ends the job, and both forms agree on each."""
    rnd = random.Random(11)
    parts = ["P", "T", "-", "+", "1", "0", "9" * 18, "9" * 19, "7", "D", "H", "M", "S", "MS", ".", ",", "5", " "]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 8))) for _ in range(3000)]
    number = lambda: rnd.choice(["0", "1", "-3", "+7", "9" * 15, "9" * 17, "9" * 20])
    made += [
        rnd.choice(["", "-"]) + "P" + rnd.choice(["", number() + "D"]) + rnd.choice(["", "T" + number() + rnd.choice("HMS")])
        for _ in range(1000)
    ]
    made += [rnd.choice(["1", "9" * 12, "9" * 18, "9" * 30]) + rnd.choice(["ms", "s", "M", "h", "d"]) for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in set(made)], "text string")
    for text, millis in rows.select("text", registry.duration_millis(F.col("text"))).collect():
        try:
            want = parse_duration(text)
        except ValueError:
            assert millis is None or millis < 1, text
        else:
            assert millis == want, text


@pytest.mark.parametrize(
    "window, name",
    [("PT0.5S", "a"), ("P1DT", "a"), ("PT10M", "a:b"), ("PT10M", "a")]
    + [(w, "a") for w in ("9223372036854775807d", "PT9223372036854775807H", "106751991167d", "52000000d")],
)
def test_check_and_builder_agree(spark, window, name):
    row = FeatureDefinition("x", "click", "COUNT", "user", window_type="TUMBLING", window="1m").as_row()
    fields = [f.name for f in schemas_of()]
    values = dict(zip(fields, row)) if not isinstance(row, dict) else dict(row)
    values |= {"name": name, "window_size": window, "slide": None}
    table = spark.createDataFrame([tuple(values[f] for f in fields)], schemas.REGISTRY)
    try:
        FeatureDefinition.from_row(values)
    except ValueError:
        assert registry.invalid(table).count() == 1
    else:
        assert registry.invalid(table).count() == 0


def schemas_of():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schemas.REGISTRY) if isinstance(schemas.REGISTRY, str) else schemas.REGISTRY


def filtered(n):
    return [
        FeatureDefinition(
            f"f{i}", "click", "SUM", "user", value_field="value",
            filter=FieldFilter("value", "GT", str(i)), window_type="TUMBLING", window=f"{i + 1}m",
        )
        for i in range(n)
    ]


def test_many_filtered_declarations(spark):
    events = views.user_events(spark, SMALL)
    some = filtered(30)
    began = time.time()
    together = compute_features(events, some)
    together._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 30
    columns = sorted(together.columns)
    got = {tuple(map(str, r)) for r in together.select(*columns).collect() if r["feature_name"] in ("f0", "f17")}
    alone = [compute_features(events, [some[i]]).select(*columns) for i in (0, 17)]
    assert got == {tuple(map(str, r)) for frame in alone for r in frame.collect()}


def test_two_active_versions_read_once(spark):
    one = FeatureDefinition("x", "click", "COUNT", "user")
    two = FeatureDefinition("x", "click", "COUNT", "user", version=2)
    lookups = spark.createDataFrame([(0, "user", "u-1", "x", None)], schemas.LOOKUPS)
    stored = spark.createDataFrame([], schemas.SERVING)
    table = registry.registry_table(spark, [two, one])
    rows = serving.read_features(lookups, stored, F.current_timestamp(), registry=table).collect()
    assert [r["definition_version"] for r in rows] == [1]


def test_unusable_row_falls_back_to_snapshot(spark, tmp_path):
    good, saved = f"{tmp_path}/registry", f"{tmp_path}/snapshot"
    table = registry.registry_table(spark, BUILT_IN_FEATURES)
    table.write.parquet(good)
    first = load_definitions(spark, good, saved)
    bad = f"{tmp_path}/bad"
    table.withColumn("aggregation_type", F.lit("MEDIAN")).write.parquet(bad)
    assert load_definitions(spark, bad, saved) == first
    with pytest.raises(ValueError):
        load_definitions(spark, bad, f"{tmp_path}/none")
