"""Epoch-aligned windows by arithmetic on epoch milliseconds.

Batch plans use these so that all window kinds share one exploded column and one shuffle.
Streams use ``F.window`` (see ``tidemark.streaming``), which keeps the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(millis: Column, step_ms: int | Column) -> Column:
    step = F.lit(step_ms) if isinstance(step_ms, int) else step_ms
    return millis - F.pmod(millis, step)


def tumbling_start(event_time: Column, size_ms: int) -> Column:
    """Start of the window holding ``event_time``, also before 1970."""
    return F.timestamp_millis(floor_to(F.unix_millis(event_time), size_ms))


def newest_sliding_start(event_time: Column, slide_ms: int) -> Column:
    """The latest aligned start that is not after ``event_time``."""
    return tumbling_start(event_time, slide_ms)


def start_millis(
    event_time: Column, window_type: str, size_ms: int | None, slide_ms: int | None
) -> Column:
    """All window starts of an event in epoch millis, ascending; ``[null]`` if unwindowed."""
    if window_type == "NONE":
        return F.array(F.lit(None).cast("bigint"))
    millis = F.unix_millis(event_time)
    if window_type == "TUMBLING":
        return F.array(floor_to(millis, size_ms))
    # The first aligned start after ``millis - size`` up to the last one not after ``millis``.
    return F.sequence(
        floor_to(millis - F.lit(size_ms), slide_ms) + F.lit(slide_ms),
        floor_to(millis, slide_ms),
        F.lit(slide_ms),
    )


def pane_starts(pane: Column, size: Column, slide: Column) -> Column:
    """Starts, in epoch millis, of all windows that hold the pane starting at ``pane``; ascending."""
    before = pane - size
    return F.sequence(before - F.pmod(before, slide) + slide, pane - F.pmod(pane, slide), slide)


def sliding_starts(event_time: Column, size_ms: int, slide_ms: int) -> Column:
    """As ``start_millis``, but as timestamps."""
    return F.transform(
        start_millis(event_time, "SLIDING", size_ms, slide_ms), F.timestamp_millis
    )


def window_expiry(written_at: Column, size_ms: int, slide_ms: int) -> Column:
    """When a window value written at ``written_at`` stops being readable."""
    return F.timestamp_millis(F.unix_millis(written_at) + F.lit(size_ms + slide_ms))


def add_millis(ts: Column, millis: Column | int) -> Column:
    """``ts`` moved by whole milliseconds, microseconds kept."""
    step = (F.lit(millis) if isinstance(millis, int) else millis).cast("bigint")
    return F.timestamp_micros(F.unix_micros(ts) + step * F.lit(1000))
