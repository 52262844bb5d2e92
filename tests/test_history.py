import datetime as dt
import random
import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.functions.quantiles import nearest_rank
from tidemark.operators import baseline, measurements
from tidemark.sources import history
from tidemark.workload import views


def test_history_written_once_and_pruned(spark, tmp_path):
    events = views.user_events(spark, SMALL)
    path = f"{tmp_path}/history"
    rows = history.history_rows(events, F.lit("run-1"), F.lit("measurement"))
    history.append_history(history.new_rows(rows, None, ["event_time"]), path)
    stored = history.read_history(spark, path)
    assert history.new_rows(rows, stored, ["event_time"]).count() == 0
    first = stored.first()
    assert (first.count_value, first.status_code, first.latency_ms) == (0, 0, 0)
    scan = history.scan_history(
        stored,
        event_type="click",
        entity_id="u-3",
        run_id="run-1",
        since=views.instant("2024-01-05 00:00:00"),
        until=views.instant("2024-01-06 12:00:00"),
    )
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "EqualTo(entity_id,u-3)" in plan
    assert "EqualTo(benchmark_phase,measurement)" in plan
    assert "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = events.where(
        "event_type = 'click' and entity.id = 'u-3' and event_time >= '2024-01-05' "
        "and event_time < '2024-01-06 12:00:00'"
    )
    assert scan.count() == want.count() > 0


def test_batches_appended_once(spark, tmp_path):
    """Redelivered ids, a batch run again, and a batch whose first run stopped before the rename."""
    path = f"{tmp_path}/history"
    schema = "event_id string, event_time timestamp, source string, event_date_note string"
    day = [dt.datetime(2024, 1, d, 12) for d in range(1, 6)]

    def batch(*rows):
        return spark.createDataFrame([(i, t, s, None) for i, t, s in rows], schema)

    first = batch(("a", day[0], "x"), ("a", day[0], "w"), ("b", day[1], "x"), (None, day[1], "x"))
    order = ["event_time", "source"]
    assert history.append_batch(first, path, 0, order)
    assert not history.append_batch(first, path, 0, order)
    (tmp_path / "history" / "_staging" / "1").mkdir(parents=True)
    second = batch(("a", day[0], "late"), ("b", day[1], "x"), ("c", day[2], "x"), ("c", day[3], "x"))
    assert history.append_batch(second, path, 1, order, copies_keep_day=True)
    assert history.append_batch(second, path, 2, order)
    assert history.append_batch(batch(), path, 3, order, copies_keep_day=True)
    kept = sorted((r.event_id or "", r.source) for r in history.read_history(spark, path).collect())
    assert kept == [("", "x"), ("a", "w"), ("b", "x"), ("c", "x")]


def test_first_rows_are_ranked_on_both_sides_of_the_shuffle(spark):
    rows = history.history_rows(views.user_events(spark, SMALL))
    plan = history.new_rows(rows, rows.limit(5), ["event_time", "event_json"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and text.count("WindowGroupLimit") >= 2
    assert plan.count() == rows.count() - 5


def stored(spark, rows):
    """History rows of (entity id, micros, count, status, latency)."""
    frame = spark.createDataFrame(rows, "entity_id string, us bigint, count_value bigint, status_code int, latency_ms bigint")
    return frame.withColumn("entity_type", F.lit("service")).withColumn("event_time", F.timestamp_micros("us")).drop("us")


def asked(spark, rows):
    frame = spark.createDataFrame(rows, "entity_id string, us bigint, feature_name string")
    return frame.withColumn("entity_type", F.lit("service")).withColumn("window_start", F.timestamp_micros("us"))


def test_asked_windows_against_a_scan(spark):
    """Starts anywhere, also on events, cell borders, before 1970 and where nothing is."""
    rnd = random.Random(5)
    minute = 60_000_000
    events = [
        (f"s{rnd.randrange(3)}", rnd.choice([rnd.randrange(-40, 40) * minute, rnd.randrange(-40 * minute, 40 * minute)]),
         rnd.randrange(5), rnd.choice([200, 500, 503]), rnd.randrange(100))
        for _ in range(400)
    ]
    starts = [rnd.randrange(-55, 55) * minute for _ in range(60)] + [e[1] for e in events[:40]]
    starts += [s + d for s in starts[:20] for d in (-1, 1)]
    pairs = [(f"s{rnd.randrange(4)}", s) for s in starts]
    lookups = [(*p, f) for p in pairs for f in baseline.WINDOW_MS] + [("s1", None, baseline.LATENCY)]
    history, wanted = stored(spark, events), asked(spark, lookups)
    now = F.lit("1970-01-01 01:00:00").cast("timestamp")
    read = {
        (r.entity_id, r.us, r.feature_name): (r.value, r.updated_at)
        for r in baseline.read_baseline(wanted, history, now).collect()
        if r.us is not None
    }
    assert read.keys() == {r for r in lookups if r[1] is not None}
    for feature, size in baseline.WINDOW_MS.items():
        one = baseline.specific_windows(history, wanted, feature).withColumn("us", F.unix_micros("window_start"))
        single = {(r.entity_id, r.us): r.value for r in one.collect()}
        for entity, start in {(e, s) for e, s, _ in lookups if s is not None}:
            inside = [e for e in events if e[0] == entity and start <= e[1] < start + size * 1000]
            requests = sum(e[2] for e in inside)
            want = {
                baseline.EVENT_COUNT: len(inside),
                baseline.ERROR_RATE: sum(e[2] for e in inside if e[3] >= 500) / requests if requests else 0.0,
                baseline.LATENCY: sum(e[2] * e[4] for e in inside) / requests if requests else 0.0,
            }[feature]
            newest = max((e[1] for e in inside), default=None)
            value, updated = read[entity, start, feature]
            assert value == single.get((entity, start)) == (pytest.approx(want) if inside else None)
            epoch = dt.datetime(1970, 1, 1)
            assert updated == (None if newest is None else epoch + dt.timedelta(microseconds=newest))


def test_many_lookups_of_one_busy_window(spark):
    """100,000 events and as many lookups of one entity in ten minutes: no pairs are made."""
    ids = spark.range(100_000)
    history = ids.select(
        F.lit("service").alias("entity_type"), F.lit("hot").alias("entity_id"),
        F.timestamp_micros(F.col("id") * 6000).alias("event_time"), F.lit(1).cast("bigint").alias("count_value"),
        F.lit(500).alias("status_code"), F.lit(3).cast("bigint").alias("latency_ms"),
    )
    lookups = ids.select(
        F.lit("service").alias("entity_type"), F.lit("hot").alias("entity_id"),
        F.timestamp_micros(F.col("id") * 6000).alias("window_start"),
    )
    began = time.monotonic()
    found = baseline.specific_windows(history, lookups, baseline.EVENT_COUNT)
    assert found.agg(F.sum("value")).first()[0] == 100_000 * 100_001 / 2
    assert time.monotonic() - began < 30
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_baseline_reads_scan_history_once(spark, tmp_path):
    path = f"{tmp_path}/history"
    stored(spark, [("s1", 5, 1, 200, 3)]).write.parquet(path)
    lookups = asked(spark, [("s1", 0, f) for f in baseline.WINDOW_MS])
    reads = baseline.read_baseline(lookups, spark.read.parquet(path), F.current_timestamp())
    assert reads._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_nearest_rank_over_many_buckets(spark):
    """Values far beyond one bucket, one of them very frequent."""
    values = [7] * 400 + [i * 99_991 for i in range(1, 301)]
    frame = spark.createDataFrame([("g", v) for v in values], "k string, v bigint")
    got = nearest_rank(frame, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.999, "e": 1.0})
    values.sort()
    want = [values[max(0, -(-len(values) * p // 1000) - 1)] for p in (0, 500, 900, 999, 1000)]
    assert list(got.first())[1:] == want


def test_empty_latency_summary(spark):
    empty = views.measurements(spark, SMALL).where("false")
    row = measurements.latency_summary(empty).first()
    assert (row["count"], row.avg_ms, row.p50_ms, row.max_ms) == (0, 0.0, 0, 0)
