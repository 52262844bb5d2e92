"""Bounded deduplication: an event id is taken again only after its marker has expired.

The first arrival of (namespace, event id) sets a marker that lives for ``retention``.
Arrivals under a live marker are duplicates and do not prolong it, so which arrivals are
taken depends on the whole chain before them.

An arrival that comes a retention or more after the one before it is taken whatever was before:
such gaps split the arrivals of a key into stretches. A stretch shorter than the retention, which is
nearly every key however many copies it has, is its first arrival: plain min aggregates. In a longer
one every arrival points to its *successor*, the first arrival a retention or more later, and the
markers are what is reached from the start. The pointers are doubled: a round joins the reached
arrivals and the pointers with the pointers, so a chain of n markers takes log2(n) rounds.

Gaps and successors are found by one ordered pass over cells as long as the retention: a successor
lies in the next cell, or is the first arrival of the one behind it. A hot key is spread over its
cells; no group holds more than the distinct arrival milliseconds of one retention.

Positions are (arrival millis, seq); ``seq`` is the message offset, unique in its namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

RETENTION_MS = 24 * 3_600_000

KEY = ["namespace", "event_id"]


def partition_namespace(namespace: Column) -> Column:
    return F.when(namespace.rlike(r"\S"), namespace).otherwise("unknown")


def _positions(rows: DataFrame) -> DataFrame:
    """One row per distinct arrival of a key: hot copies collapse before the shuffle."""
    return (
        rows.where(F.col("event_id").isNotNull() & F.col("arrival_time").isNotNull())
        .select(*KEY, F.unix_millis("arrival_time").alias("arrival_ms"), "seq")
        .groupBy(*KEY, "arrival_ms")
        .agg(F.min("seq").alias("seq"))
    )


def _key_spans(positions: DataFrame) -> DataFrame:
    return positions.groupBy(*KEY).agg(
        F.min("arrival_ms").alias("first_ms"),
        F.min_by("seq", "arrival_ms").alias("first_seq"),
        F.max("arrival_ms").alias("last_ms"),
    )


def first_arrivals(rows: DataFrame) -> DataFrame:
    """The first arrival of every key, when retention outlasts the data."""
    return _key_spans(_positions(rows)).select(
        *KEY, F.col("first_ms").alias("marker_ms"), F.col("first_seq").alias("marker_seq")
    )


def _stretches(positions: DataFrame, retention_ms: int) -> DataFrame:
    """The starts of stretches (``from_ms`` is null) and the pointers to successors.

    Columns: the key, ``from_ms``, ``to_ms``, ``to_seq``. In the ordered pass of a cell stand its
    arrivals, the last arrival of the cell before, the first of the cell behind, and for every
    arrival of the cell before the instant its marker expires.
    """
    retention = F.lit(retention_ms)
    nothing = F.lit(None).cast("bigint")
    at = F.struct(F.col("arrival_ms").alias("ms"), "seq")
    cell = F.floor(F.col("arrival_ms") / retention)
    no_arrival = F.lit(None).cast("struct<ms: bigint, seq: bigint>")
    arrivals = positions.select(
        *KEY,
        F.inline(
            F.array(
                F.struct(
                    cell.alias("cell"),
                    F.col("arrival_ms").alias("ms"),
                    F.lit(1).alias("kind"),
                    at.alias("arrival"),
                    nothing.alias("from_ms"),
                ),
                F.struct(
                    (cell + 1).alias("cell"),
                    (F.col("arrival_ms") + retention).alias("ms"),
                    F.lit(0).alias("kind"),
                    no_arrival.alias("arrival"),
                    F.col("arrival_ms").alias("from_ms"),
                ),
            )
        ),
    )
    ends = positions.groupBy(*KEY, cell.alias("cell")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    around = ends.select(
        *KEY,
        F.inline(
            F.array(
                F.struct((F.col("cell") + 1).alias("cell"), F.col("last").alias("arrival")),
                F.struct((F.col("cell") - 1).alias("cell"), F.col("first").alias("arrival")),
            )
        ),
    ).select(*KEY, "cell", F.col("arrival.ms").alias("ms"), F.lit(2).alias("kind"), "arrival", nothing.alias("from_ms"))
    in_order = Window.partitionBy(*KEY, "cell").orderBy("ms", "kind")
    passed = arrivals.unionByName(around).select(
        "*",
        F.expr("lag(arrival) IGNORE NULLS").over(in_order).alias("before"),
        F.expr("lead(arrival) IGNORE NULLS").over(in_order).alias("behind"),
    )
    starts = (F.col("kind") == 1) & F.coalesce(F.col("ms") - F.col("before.ms") >= retention, F.lit(True))
    # A successor behind a gap starts a stretch of its own.
    points = (F.col("kind") == 0) & (F.col("behind.ms") - F.col("before.ms") < retention)
    to = F.when(F.col("kind") == 1, F.col("arrival")).otherwise(F.col("behind"))
    return passed.where(starts | points).select(
        *KEY, "from_ms", to["ms"].alias("to_ms"), to["seq"].alias("to_seq")
    )


def _reached(stretches: DataFrame) -> DataFrame:
    """(key, marker_ms, marker_seq): the starts and all that pointers lead to."""
    marker = [F.col("to_ms").alias("marker_ms"), F.col("to_seq").alias("marker_seq")]
    reached = stretches.where(F.col("from_ms").isNull()).select(*KEY, *marker)
    pointers = stretches.where(F.col("from_ms").isNotNull())
    while not pointers.isEmpty():
        next_ones = pointers.withColumnRenamed("from_ms", "marker_ms")
        found = reached.drop("marker_seq").join(next_ones, [*KEY, "marker_ms"]).select(*KEY, *marker)
        # One start to a stretch, and pointers lead forward: nothing is reached twice.
        reached = reached.unionByName(found).checkpoint()
        further = pointers.select(*KEY, F.col("from_ms").alias("to_ms"), *[F.col(c).alias(f"far_{c}") for c in ("to_ms", "to_seq")])
        pointers = (
            pointers.drop("to_seq")
            .join(further, [*KEY, "to_ms"])
            .select(*KEY, "from_ms", F.col("far_to_ms").alias("to_ms"), F.col("far_to_seq").alias("to_seq"))
            .checkpoint()
        )
    return reached


def markers(rows: DataFrame, retention_ms: int = RETENTION_MS) -> DataFrame:
    """(namespace, event_id, marker_ms, marker_seq): every arrival that is taken.

    The distinct positions are checkpointed first, so that ``rows`` are read once; keys that
    outlive their marker are then solved, in rounds logarithmic in their longest chain.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    positions = _positions(rows).checkpoint()
    spans = _key_spans(positions)
    outlives = F.col("last_ms") >= F.col("first_ms") + F.lit(retention_ms)
    short = spans.where(~outlives).select(
        *KEY, F.col("first_ms").alias("marker_ms"), F.col("first_seq").alias("marker_seq")
    )
    long_lived = positions.join(spans.where(outlives).select(*KEY), KEY, "left_semi")
    return short.unionByName(_reached(_stretches(long_lived, retention_ms).checkpoint()))


def live_markers(taken: DataFrame, now: Column, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Markers that have not expired at ``now``, with their expiry."""
    expiry = F.timestamp_millis(F.max("marker_ms") + F.lit(retention_ms))
    return taken.groupBy(*KEY).agg(expiry.alias("expires_at")).where(F.col("expires_at") > now)


def label(
    rows: DataFrame, taken: DataFrame, retention_ms: int = RETENTION_MS
) -> DataFrame:
    """Add ``is_taken`` and ``is_duplicate``.

    A marker can cover arrivals in its own retention-long cell and the next one, so each
    (key, cell) needs at most two markers: one join row per event, whatever the number of
    copies, with hot keys spread over their cells.
    """
    cell = F.floor(F.col("marker_ms") / F.lit(retention_ms))
    per_cell = (
        taken.select(
            *KEY,
            F.inline(
                F.array(
                    F.struct(
                        cell.alias("cell"),
                        F.col("marker_ms").alias("own_ms"),
                        F.col("marker_seq").alias("own_seq"),
                        F.lit(None).cast("bigint").alias("before_ms"),
                    ),
                    F.struct(
                        (cell + 1).alias("cell"),
                        F.lit(None).cast("bigint").alias("own_ms"),
                        F.lit(None).cast("bigint").alias("own_seq"),
                        F.col("marker_ms").alias("before_ms"),
                    ),
                )
            ),
        )
        .groupBy(*KEY, "cell")
        .agg(*[F.max(c).alias(c) for c in ("own_ms", "own_seq", "before_ms")])
    )
    arrival = F.unix_millis("arrival_time")
    is_own = (arrival == F.col("own_ms")) & (F.col("seq") == F.col("own_seq"))
    after_own = (arrival > F.col("own_ms")) | (
        (arrival == F.col("own_ms")) & (F.col("seq") > F.col("own_seq"))
    )
    under_before = arrival < F.col("before_ms") + F.lit(retention_ms)
    return (
        rows.withColumn("cell", F.floor(arrival / F.lit(retention_ms)))
        .join(per_cell, [*KEY, "cell"], "left")
        .select(
            *[F.col(c) for c in rows.columns],
            F.coalesce(is_own, F.lit(False)).alias("is_taken"),
            (
                F.coalesce(after_own, F.lit(False)) | F.coalesce(under_before, F.lit(False))
            ).alias("is_duplicate"),
        )
    )
