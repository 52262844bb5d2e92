import random
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.definitions import BUILT_IN_FEATURES
from tidemark.operators import monitoring
from tidemark.operators.outcomes import event_outcomes, reject_late
from tidemark.plans.features import compute_features
from tidemark.sources import registry
from tidemark.sources.events import encode_events
from tidemark.streaming import gold, silver, snapshot, sources
from tidemark.streaming.dedup import drop_fast
from tidemark.workload import views

DAY = 86_400_000
FEATURES = [
    views.feature(n) for n in ("purchase_value_total", "click_count_1h_15m", "distinct_k_1d")
]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    silver.require_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def slices(frame, path, cuts):
    """Write ``frame`` as one file per arrival range; returns a writer per slice."""
    at = F.unix_millis("arrival_time")
    low, high = frame.select(F.min(at), F.max(at) + 1).first()
    edges = [low + (high - low) * i // cuts for i in range(cuts + 1)]

    def write(i):
        part = frame.where((at >= edges[i]) & (at < edges[i + 1]))
        part.coalesce(1).write.mode("append").parquet(path)

    return write


def test_outcomes_of_a_stream_equal_batch(spark, tmp_path):
    """Ids come back after 5, 24 and 30 hours, over a restart."""
    events = views.redelivered_events(spark, SMALL)
    messages = events.select(
        "namespace", "seq", "arrival_time", encode_events(events).alias("value")
    )
    allowed = 30 * 3_600_000 - 1
    write = slices(messages, f"{tmp_path}/in", 2)
    for i in range(2):
        write(i)
        stream = sources.file_messages(spark, f"{tmp_path}/in", max_files_per_trigger=1)
        query = silver.write_outcomes(
            stream, FEATURES, f"{tmp_path}/out", f"{tmp_path}/cp", allowed_ms=allowed
        )
        query.awaitTermination()
    columns = ["namespace", "event_id", "seq", "outcome", "late_accepted", "reason"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*columns)
    want = event_outcomes(events, FEATURES, allowed_ms=allowed).select(*columns)
    assert got.count() == want.count()
    assert want.exceptAll(got).count() == 0
    assert {"duplicate", "late", "processed"} <= {
        r.outcome for r in got.select("outcome").distinct().collect()
    }
    # One row of counters per batch, over the restart.
    counters = spark.read.parquet(f"{tmp_path}/out.counters")
    assert counters.count() == 2
    totals = silver.counter_totals(counters).first().asDict()
    assert totals == monitoring.outcome_counts(spark.read.parquet(f"{tmp_path}/out")).first().asDict()


def arrivals(spark, rows):
    """Judged rows as ``write_batch`` gets them, of (event id, arrival hour, seq, leaves a marker)."""
    frame = spark.createDataFrame(rows, "event_id string, hour bigint, seq bigint, leaves_marker boolean")
    at = F.timestamp_millis(F.col("hour") * 3_600_000)
    nothing = {"event_type": "string", "payload_json": "string", "timing": "string", "reason": "string"}
    return frame.select(
        F.lit("p-0").alias("namespace"),
        "seq",
        at.alias("arrival_time"),
        "event_id",
        *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()],
        at.alias("event_time"),
        F.struct(F.lit("s").alias("type"), F.lit("e").alias("id")).alias("entity"),
        F.lit(0).cast("bigint").alias("lag_ms"),
        F.lit(False).alias("late_accepted"),
        F.lit("processed").alias("verdict"),
        F.lit(True).alias("dedup"),
        "leaves_marker",
    )


def test_batches_against_a_sequential_worker(spark, tmp_path):
    """Batches run again leave all tables as they are; markers end to the millisecond; old days go."""
    rnd = random.Random(4)
    path, seq, expiry, want, hour = f"{tmp_path}/out", 0, {}, {}, 0
    for batch in range(6):
        rows = []
        for _ in range(60):
            hour += rnd.choice([0, 0, 0, 0, 0, 1, 1])
            rows.append((rnd.choice(["hot", "hot", *(f"k{k}" for k in range(25))]), hour, seq, rnd.random() < 0.8))
            seq += 1
        for event_id, at, number, marks in rows:
            want[number] = "duplicate" if at < expiry.get(event_id, -1) else "processed"
            if marks and want[number] == "processed":
                expiry[event_id] = at + 24
        frame = arrivals(spark, rows)
        silver.write_batch(frame, batch, path, compact_every=2)
        if batch % 2:
            before = {n: spark.read.parquet(f"{path}{n}").inputFiles() for n in ("", ".counters")}
            silver.write_batch(frame, batch, path, compact_every=0)
            assert before == {n: spark.read.parquet(f"{path}{n}").inputFiles() for n in before}
        got = {r.seq: r.outcome for r in spark.read.parquet(path).select("seq", "outcome").collect()}
        assert got == want
    days = [int(p.name.split("=")[1]) for p in (tmp_path / "out.markers").glob("expiry_day=*")]
    assert min(days) >= (hour - 120) // 24 and max(days) == max(expiry.values()) // 24
    assert not list((tmp_path / "out.markers" / "_staging").glob("*"))
    assert list((tmp_path / "out.markers").glob("expiry_day=*/batch_id=-*"))


def test_counters_of_a_batch_whose_first_attempt_stopped(spark, tmp_path):
    path = f"{tmp_path}/out"
    frame = arrivals(spark, [("a", 1, 1, True), ("a", 2, 2, True), ("b", 2, 3, True)])
    silver.write_batch(frame, 0, path)
    for part in ("out.counters/batch_id=0", "out.markers"):
        (tmp_path / part).rename(tmp_path / f"lost-{part.replace('/', '-')}")
    silver.write_batch(frame, 0, path)
    totals = silver.counter_totals(spark.read.parquet(f"{path}.counters")).first()
    assert (totals.received, totals.processed, totals.duplicate) == (3, 2, 1)
    assert spark.read.parquet(f"{path}.markers").count() == 2


def test_an_empty_batch(spark, tmp_path):
    silver.write_batch(arrivals(spark, []), 0, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out.counters").first().received == 0


def test_features_of_a_stream_equal_batch(spark, tmp_path):
    """With late corrections, a restart, and state that shrinks behind the watermark."""
    events = reject_late(views.user_events(spark, SMALL))
    write = slices(events, f"{tmp_path}/in", 3)
    for i in range(3):
        write(i)
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        query = gold.write_changelog(stream, FEATURES, f"{tmp_path}/log", f"{tmp_path}/cp")
        query.awaitTermination()
    state_rows = sum(s.numRowsTotal for s in query.lastProgress.stateOperators)
    columns = ["entity_id", "feature_name", "window_start", F.round("value", 6), "n", "updated_at"]
    want = compute_features(events, FEATURES).select(*columns).collect()

    def rows(path):
        return gold.feature_rows(spark.read.parquet(path), FEATURES).select(*columns).collect()

    key = str
    assert sorted(rows(f"{tmp_path}/log"), key=key) == sorted(want, key=key)
    gold.compact(spark, f"{tmp_path}/log", f"{tmp_path}/compacted")
    assert sorted(rows(f"{tmp_path}/compacted"), key=key) == sorted(want, key=key)
    assert state_rows < len(want) / 4
    assert len(query.lastProgress.stateOperators) == 1 and len(query.lastProgress.sources) == 1

    # Finished panes merged, twice: windows stay the same and total features need one row.
    ends = events.select(F.expr("percentile_approx(event_time, array(0.5, 0.9))")).first()[0]
    source = f"{tmp_path}/compacted"
    for i, end in enumerate(ends):
        gold.compact(spark, source, f"{tmp_path}/settled{i}", FEATURES, end)
        source = f"{tmp_path}/settled{i}"
        assert sorted(rows(source), key=key) == sorted(want, key=key)
    settled = spark.read.parquet(source).where("settled and feature_name = 'purchase_value_total'")
    assert settled.count() == settled.select("entity_id").distinct().count() > 0
    assert spark.read.parquet(source).count() < spark.read.parquet(f"{tmp_path}/compacted").count()

    footprint = monitoring.state_footprint(spark, query.recentProgress).orderBy("batch_id").collect()
    assert footprint[-1].entries == state_rows
    assert sum(r.updated for r in footprint) > 0 and {r.operator for r in footprint} == {0}


def test_one_stateful_operator_for_sixty_kinds_of_window(spark, tmp_path):
    events = reject_late(views.user_events(spark, SMALL)).where("entity.id < 'u-2'")
    kinds = [
        replace(views.feature("click_count_1h_15m"), name=f"clicks_{k}", window=(k + 2) * 900_000, slide=900_000)
        for k in range(60)
    ]
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = gold.write_changelog(stream, kinds, f"{tmp_path}/log", f"{tmp_path}/cp", 365 * DAY)
    query.awaitTermination()
    assert len(query.recentProgress[0].stateOperators) == 1
    # All panes are open still: the stream's figures and the entries of its checkpoint agree.
    footprint = monitoring.state_footprint(spark, query.recentProgress).orderBy("batch_id").collect()
    size = monitoring.state_size(monitoring.stream_state_entries(spark, f"{tmp_path}/cp")).first()
    assert footprint[-1].entries == size.entries > 0 and footprint[-1].memory_bytes > 0
    assert size.key_bytes > 0 and size.value_bytes > 0
    columns = ["entity_id", "feature_name", "window_start", "value"]
    got = gold.feature_rows(spark.read.parquet(f"{tmp_path}/log"), kinds).select(*columns)
    want = compute_features(events, kinds).select(*columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_fast_dedup_drops_copies(spark, tmp_path):
    events = views.repeated_events(spark, SMALL).drop("payload", "entity")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = (
        drop_fast(stream)
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == kept.select("namespace", "event_id").distinct().count() == 1000


def test_definition_snapshot(spark, tmp_path):
    table, saved = f"{tmp_path}/registry", f"{tmp_path}/snapshot"
    with pytest.raises(Exception):
        snapshot.load_definitions(spark, table, saved)
    registry.registry_table(spark, BUILT_IN_FEATURES).write.parquet(table)
    loaded = snapshot.load_definitions(spark, table, saved)
    assert sorted(d.name for d in loaded) == sorted(d.name for d in BUILT_IN_FEATURES)
    assert snapshot.load_definitions(spark, f"{tmp_path}/gone", saved) == loaded


def test_messages_for_a_topic(spark):
    events = views.user_events(spark, SMALL)
    row = sources.as_messages(events).where("key = 'u-13'").first()
    assert row.value.startswith('{"eventId":')
    assert schemas.RAW_MESSAGES.count("string") == 2
