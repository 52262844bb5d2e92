"""Bounded deduplication on a stream.

Live markers are a table, partitioned by the day they expire and by the batch that set them. A
micro-batch meets the markers of earlier batches only, in joins on slim columns: what lies under a
live marker is a duplicate, the rest is solved as a batch of its own. So an id is taken again from
the very millisecond its marker ends. Expired markers leave by whole days.

``drop_fast`` keeps state instead: copies within the retention are dropped for sure, but an id may
be held back for up to twice as long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.operators.dedup import KEY, RETENTION_MS
from tidemark.streaming.batches import Folder

DAY_MS = 24 * 3_600_000
# Arrival times are stamped on reading, so they hardly run backwards between batches.
ARRIVAL_DISORDER_MS = 3_600_000
# Batches of a day after which their marker folders become one.
COMPACT_EVERY = 100

_MARKERS = "namespace string, event_id string, expires_ms bigint, expiry_day bigint, batch_id bigint"


class MarkerTable:
    """The markers of a stream: ``path/expiry_day=D/batch_id=N``, D in days since 1970."""

    def __init__(self, spark: SparkSession, path: str, retention_ms: int = RETENTION_MS) -> None:
        self._spark, self._path, self._retention_ms = spark, path, retention_ms
        self._folder = Folder(spark, path)

    def before(self, batch_id: int, from_ms: int) -> DataFrame:
        """(key, expires_ms) of markers set before ``batch_id`` that live at ``from_ms`` or later."""
        if not self._folder.names():
            return self._spark.createDataFrame([], "namespace string, event_id string, expires_ms bigint")
        found = self._spark.read.schema(_MARKERS).parquet(self._path)
        return found.where(
            (F.col("expiry_day") >= from_ms // DAY_MS)
            & (F.col("batch_id") < batch_id)
            & (F.col("expires_ms") > from_ms)
        ).select(*KEY, "expires_ms")

    def add(self, taken: DataFrame, batch_id: int) -> None:
        """Set the markers of a batch. Days it had set already, in an attempt that failed, stay."""
        staged = self._folder.child(f"_staging/{batch_id}")
        expires = F.col("marker_ms") + F.lit(self._retention_ms)
        (
            taken.select(*KEY, expires.alias("expires_ms"), F.floor(expires / F.lit(DAY_MS)).alias("expiry_day"))
            .write.mode("overwrite")
            .partitionBy("expiry_day")
            .parquet(staged.path)
        )
        for day in staged.names():
            target = self._folder.child(f"{day}/batch_id={batch_id}")
            if not target.exists():
                staged.child(day).move_to(target)
        staged.remove()

    def drop_expired(self, before_ms: int) -> list[str]:
        """Remove the days that ended before ``before_ms``; returns their names."""
        gone = [d for d in self._folder.names() if int(d.split("=")[1]) < before_ms // DAY_MS]
        for day in gone:
            self._folder.child(day).remove()
        return gone

    def compact(self, batch_id: int) -> None:
        """One folder per day instead of one per batch before ``batch_id``.

        Its number is negative, so every later batch reads it. Markers that stand twice while the
        old folders go are the same markers: reads take the latest expiry of a key.
        """
        for day in self._folder.names():
            folder = self._folder.child(day)
            target = folder.child(f"batch_id={-batch_id - 1}")
            merged = [folder.child(n) for n in folder.names() if int(n.split("=")[1]) < batch_id]
            merged = [part for part in merged if part.path != target.path]
            if not target.exists():
                if len(merged) < 2:
                    continue
                staged = self._folder.child(f"_staging/{day}")
                slim = "namespace string, event_id string, expires_ms bigint"
                parts = self._spark.read.schema(slim).parquet(*[part.path for part in merged])
                parts.coalesce(max(1, len(merged) // 50)).write.mode("overwrite").parquet(staged.path)
                staged.move_to(target)
            for part in merged:
                part.remove()


def label_batch(
    rows: DataFrame, markers: MarkerTable, batch_id: int, retention_ms: int = RETENTION_MS
) -> tuple[DataFrame, DataFrame]:
    """The rows of a micro-batch with ``is_duplicate``, and the markers it sets.

    ``rows`` need the key, ``arrival_time``, ``seq`` and ``leaves_marker``. A row that leaves no
    marker is a duplicate under a live one like any other.
    """
    arrival = F.unix_millis("arrival_time")
    earliest = rows.agg(F.min(arrival)).first()[0]
    from_ms = 0 if earliest is None else earliest
    keys = rows.select(*KEY).distinct()
    live = markers.before(batch_id, from_ms).join(keys, KEY, "left_semi").groupBy(*KEY).agg(
        F.max("expires_ms").alias("expires_ms")
    )
    met = rows.join(live, KEY, "left")
    covered = F.coalesce(arrival < F.col("expires_ms"), F.lit(False))
    free = met.where(~covered & F.col("leaves_marker")).select(*KEY, "arrival_time", "seq")
    taken = dedup.markers(free, retention_ms)
    labelled = dedup.label(met.withColumn("is_covered", covered), taken, retention_ms)
    duplicate = F.col("is_covered") | F.col("is_duplicate")
    return labelled.select(*rows.columns, duplicate.alias("is_duplicate")), taken


def drop_fast(rows: DataFrame, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Rows without copies inside the retention; markers follow the arrival clock."""
    marked = rows.withWatermark("arrival_time", f"{retention_ms} milliseconds")
    return marked.dropDuplicatesWithinWatermark(KEY)
