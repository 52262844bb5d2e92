"""Repeated windows of a corpus, found shard by shard: what the two substring operators share.

A window is ``length`` consecutive units (words or bytes) of one document. Its anchor is the
smallest hash of the grams inside it, so equal windows have equal anchors wherever they occur. Each
document is cut into segments, runs of windows with one anchor. Then

1. later copies of a whole text are set aside: all their windows occur earlier;
2. anchors that can hold no repeat are found by a fixed-width aggregate and dropped, which leaves
   few segments of ordinary text;
3. segments go to shards by anchor, moved once; a shard reduces equal ones to one with its earliest
   occurrence, and its index tells for each window of each segment which occurrence in the corpus is
   the earliest;
4. there all occurrences of the segment that have an earlier one are marked.

An anchor with more than ``hot`` occurrences is cut into single windows with keys of their own. Equal
ones are reduced by an aggregate before they go to shards and joined back after, so that no shard
grows with the corpus.

While the repeating anchors are few they are broadcast and segments are cut at once. Beyond that
segments meet them without their text, and the text of those that are left is cut per document.

Documents are told apart by doc_id and the hash of their text; a null doc_id counts as smaller than
all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import complete_groups, discard, pieces, small, written

HOT = 20_000
# Anchors up to which the table of those that repeat may be broadcast (8 bytes each).
ANCHORS = 4_000_000
# Later copies of whole texts up to which their table (16 bytes a row) may be broadcast, and spans
# up to which the table of spans may be. The latter is low: as soon as a corpus has some size its text
# is shuffled to the spans, so that what it takes grows as the input does.
COPIES, SPANS = 1_000_000, 1 << 16
# Segments in one shard, unless one anchor has more.
SHARD = 1 << 13

PLACE = "anchor long, k1 long, k2 long, start long, windows int"


@dataclass
class Units:
    """How a text is cut: its windows, and what a segment's bytes are."""

    length: int
    gram: int
    # Text to (gram hashes, function from a range of units to bytes).
    cut: Callable[[str | None], tuple[np.ndarray, Callable[[int, int], bytes]]]
    # Text to that function alone.
    body: Callable[[str | None], Callable[[int, int], bytes]]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def cut_segments(grams: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, anchor occurs more than once in it) of all segments."""
    width = units.length - units.gram + 1
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    least = sliding_min(grams, width)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(start, append=len(least))
    anchor = least[start]
    span = count + width - 1
    at = np.repeat(start - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
    same = grams[at] == np.repeat(anchor, span)
    many = np.add.reduceat(same, np.cumsum(span) - span, dtype=np.int64) > 1
    return anchor, start, count, many


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(text).alias("k2"),
        F.col(text).alias("text"),
    )


def anchor_rows(rows: DataFrame, units: Units, places: bool, bodies: bool = False) -> DataFrame:
    """(anchor, k1, many) per segment; with ``places`` where it is, with ``bodies`` also its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ["text"], 4 << 20):
                k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
                found, counts, texts = [], [], []
                for value in part.column("text"):
                    grams, body = units.cut(value.as_py())
                    made = cut_segments(grams, units)
                    found.append(made)
                    counts.append(len(made[0]))
                    if bodies:
                        ends = (made[1] + made[2] + units.length - 1).tolist()
                        texts += map(body, made[1].tolist(), ends)
                if not sum(counts):
                    continue
                anchor, start, count, many = (np.concatenate(x) for x in zip(*found))
                columns = {"anchor": anchor.view(np.int64), "k1": np.repeat(k1, counts)}
                if places:
                    columns |= {"k2": np.repeat(k2, counts), "start": start, "windows": count.astype(np.int32)}
                else:
                    columns["many"] = many
                arrays = [pa.array(x) for x in columns.values()]
                names = list(columns)
                if bodies:
                    arrays.append(pa.array(texts, pa.binary()))
                    names.append("body")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = ", body binary" if bodies else ""
    return rows.mapInArrow(run, f"{PLACE}{more}" if places else "anchor long, k1 long, many boolean")


def bodies_of(rows: DataFrame, units: Units) -> DataFrame:
    """The segments listed in ``places`` of each row, with their text and ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ["text", "places"], 4 << 20):
                places = part.column("places")
                counts = np.diff(places.offsets.to_numpy())
                inside = places.flatten()
                columns = {c: inside.field(c) for c in ("anchor", "start", "windows", "hot")}
                start = columns["start"].to_numpy()
                ends = (start + columns["windows"].to_numpy() + units.length - 1).tolist()
                starts, bodies, at = start.tolist(), [], 0
                for value, n in zip(part.column("text"), counts.tolist()):
                    bodies += map(units.body(value.as_py()), starts[at : at + n], ends[at : at + n])
                    at += n
                k1, k2 = (pa.array(np.repeat(part.column(c).to_numpy(), counts)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [columns["anchor"], k1, k2, columns["start"], columns["windows"], pa.array(bodies, pa.binary()), columns["hot"]],
                    names=["anchor", "k1", "k2", "start", "windows", "body", "hot"],
                )

    return rows.mapInArrow(run, f"{PLACE}, body binary, hot boolean")


def split_hot(segments: DataFrame, units: Units, window: Callable[[bytes, int], list[bytes]]) -> DataFrame:
    """The segments cut into single windows, each with a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row in batch.to_pylist():
                bodies = window(row["body"], row["windows"])
                n = len(bodies)
                keys = [xxhash.xxh3_64_intdigest(b) for b in bodies]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(keys, np.uint64).view(np.int64)),
                        pa.array([row["k1"]] * n, pa.int64()),
                        pa.array([row["k2"]] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int64) + row["start"]),
                        pa.array([1] * n, pa.int32()),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["anchor", "k1", "k2", "start", "windows", "body"],
                )

    wanted = segments.select("k1", "k2", "start", "windows", "body")
    return wanted.mapInArrow(run, f"{PLACE}, body binary")


def runs_of(segment: np.ndarray, offset: np.ndarray, e1: np.ndarray, e2: np.ndarray, at: np.ndarray):
    """(segment, first, last, e1, e2, at) of the runs of windows whose earliest occurrences follow each other."""
    new = np.ones(len(segment), bool)
    new[1:] = (
        (segment[1:] != segment[:-1])
        | (e1[1:] != e1[:-1])
        | (e2[1:] != e2[:-1])
        | (at[1:] - at[:-1] != offset[1:] - offset[:-1])
    )
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(segment))[: len(first)] - 1
    return segment[first], offset[first], offset[last], e1[first], e2[first], at[first]


def candidates(rows: DataFrame, copies: DataFrame, found: DataFrame, units: Units) -> tuple[DataFrame, list[DataFrame]]:
    """The segments of the anchors in ``found``, without those of copies, and the tables written for it."""
    if found.count() <= ANCHORS:
        alone = rows.join(small(copies, COPIES), ["k1", "k2"], "left_anti")
        return anchor_rows(alone, units, places=True, bodies=True).join(F.broadcast(found), "anchor"), []
    places = (
        anchor_rows(rows, units, places=True)
        .join(found.hint("shuffle_hash"), "anchor")
        .join(small(copies, COPIES), ["k1", "k2"], "left_anti")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("anchor", "start", "windows", "hot")).alias("places"))
    )
    places = written(places, "places", release=True)
    return bodies_of(rows.join(places, ["k1", "k2"]), units), [places]


def repeated_spans(
    docs: DataFrame,
    units: Units,
    shard: Callable[..., tuple],
    window: Callable[[bytes, int], list[bytes]],
    seen: dict[str, Column],
    repeats: Column,
    earlier: Callable,
    key: str = "doc_id",
    text: str = "text",
    hot: int = HOT,
) -> DataFrame:
    """(k1, k2, spans): the windows of each document that occur earlier, as ranges of units (written).

    ``shard`` gets the segments of a shard (anchor, body, windows, e1, e2, at as arrays) and gives
    the runs of each. ``seen`` are aggregates over the rows (k1, many) of an anchor, and ``repeats``
    says by them and the count ``n`` which anchors can hold a repeat; ``earlier`` says of arrays and
    of columns whether the occurrence (e1, e2, at) of a window comes before the one at (k1, k2, place).
    """
    rows = keyed(docs, key, text)
    first = rows.groupBy("k2", F.xxhash64(F.lit(1), "text").alias("k3")).agg(
        F.min("k1").alias("low"), F.max("k1").alias("high")
    )
    twice = written(first.where("low < high").select("k2", "k3", "low"), "copied", release=True)
    copies = (
        rows.withColumn("k3", F.xxhash64(F.lit(1), "text"))
        .join(small(twice, COPIES), ["k2", "k3"])
        .where("k1 > low")
        .select("k1", "k2")
        .distinct()
    )
    copies = written(copies, "copies", release=True)

    found = (
        anchor_rows(rows.join(small(copies, COPIES), ["k1", "k2"], "left_anti"), units, places=False)
        .groupBy("anchor")
        .agg(F.count("*").alias("n"), *(x.alias(c) for c, x in seen.items()))
        .where(repeats)
        .select("anchor", (F.col("n") > hot).alias("hot"))
    )
    found = written(found, "anchors", release=True)
    segments, used = candidates(rows, copies, found, units)
    used += [twice, copies, found]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in complete_groups(batches, ["anchor"], SHARD):
            numbers = {c: part[c].to_numpy() for c in ("anchor", "windows", "k1", "k2", "start")}
            k1, k2, start = (numbers[c] for c in ("k1", "k2", "start"))
            bodies = part["body"].combine_chunks().dictionary_encode()
            same = bodies.indices.to_numpy()
            order = np.lexsort((start, k2, k1, same))
            least = order[np.flatnonzero(np.diff(same[order], prepend=-1))]
            segment, begin, end, e1, e2, at = shard(
                bodies.dictionary.to_pylist(), **{c: x[least] for c, x in numbers.items()}
            )
            # The runs of a segment hold for all its occurrences.
            runs = np.bincount(segment, minlength=len(least))
            many = runs[same]
            row = np.repeat(np.arange(len(same)), many)
            run = np.arange(len(row)) + np.repeat((np.cumsum(runs) - runs)[same] - np.cumsum(many) + many, many)
            late = earlier(e1[run], e2[run], at[run], k1[row], k2[row], start[row] + begin[run])
            row, run = row[late], run[late]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (k1[row], k2[row], start[row] + begin[run], start[row] + end[run] + units.length)],
                names=["k1", "k2", "begin", "end"],
            )

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in complete_groups(batches, ["anchor"], SHARD):
            numbers = {c: part[c].to_numpy() for c in ("anchor", "windows", "k1", "k2", "start")}
            segment, _, _, *earliest = shard(part["body"].to_pylist(), **numbers)
            keys = [part[c].to_numpy()[segment] for c in ("anchor", "bhash")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*keys, *earliest)], names=["anchor", "bhash", "e1", "e2", "at"]
            )

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition("anchor").sortWithinPartitions("anchor")

    spans = "k1 long, k2 long, begin long, end long"
    if found.where("hot").limit(1).count():
        segments = written(segments, "segments", release=True)
        windows = split_hot(segments.where("hot"), units, window).withColumn("bhash", F.xxhash64("body"))
        distinct = (
            windows.groupBy("anchor", "bhash", "windows")
            .agg(F.min(F.struct("k1", "k2", "start")).alias("e"), F.first("body").alias("body"))
            .select("anchor", "bhash", "windows", "e.k1", "e.k2", "e.start", "body")
        )
        results = dealt(distinct).mapInArrow(indexed, "anchor long, bhash long, e1 long, e2 long, at long")
        results = written(results, "results", release=True)
        inside = (
            windows.select("anchor", "bhash", "k1", "k2", "start")
            .join(results, ["anchor", "bhash"])
            .where(earlier(*(F.col(c) for c in ("e1", "e2", "at", "k1", "k2", "start"))))
            .select("k1", "k2", F.col("start").alias("begin"), (F.col("start") + units.length).alias("end"))
        )
        used += [segments, results]
        inside = inside.unionAll(dealt(segments.where("not hot").drop("hot")).mapInArrow(marked, spans))
    else:
        inside = dealt(segments.drop("hot")).mapInArrow(marked, spans)
    # A copy is covered whole, if it has a window; its length is not known here.
    whole = copies.select("k1", "k2", F.lit(0).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"))
    ranges = (
        inside.unionAll(whole)
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    )
    ranges = written(ranges, "spans", release=True)
    for frame in used:
        discard(frame)
    return ranges


def with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``docs`` with its (written) spans in column ``name`` (null where it has none)."""
    k1, k2 = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    size = spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0]
    right = spans.select(F.col("k1").alias(f"{name}_1"), F.col("k2").alias(f"{name}_2"), F.col("spans").alias(name))
    right = F.broadcast(right) if size <= SPANS else right
    return docs.join(right, (k1 == F.col(f"{name}_1")) & (k2 == F.col(f"{name}_2")), "left").drop(
        f"{name}_1", f"{name}_2"
    )


def covered(spans: pa.Scalar, size: int, length: int) -> np.ndarray:
    """Which of ``size`` units lie in one of the spans; an end of -1 stands for all, if there are
    ``length`` units or more."""
    edge = np.zeros(size + 1, np.int64)
    if spans.is_valid and len(spans.values):
        begin, end = (spans.values.field(c).to_numpy() for c in ("begin", "end"))
        whole = end < 0
        np.add.at(edge, begin[~whole], 1)
        np.add.at(edge, end[~whole], -1)
        if whole.any() and size >= length:
            edge[0] += 1
    return np.cumsum(edge)[:-1] > 0


def runs_in(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))



