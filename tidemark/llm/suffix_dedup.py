"""Removal of byte strings repeated from earlier documents, by a hash-compared suffix sort.

A text is its UTF-8 bytes. Every byte covered by a 50-byte string that also starts in a document
with a smaller doc_id is removed; strings are judged on the input and never cross documents.
Segments that may repeat go to shards by content (see ``anchored``). In a shard the suffixes of all
segments are sorted: those with one anchor and the same first bytes by a mergesort whose comparisons
find the common extension of two suffixes by binary search on prefix polynomial hashes, so a
comparison takes a logarithmic number of steps. All comparisons of a merge level are made at once in
numpy. Neighbours that share a whole window are then checked byte by byte; should a hash have
collided, the shard is sorted by the bytes instead.

Null texts are empty. Rows with one doc_id never remove from each other; a null doc_id counts as
smaller than all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import anchored
from tidemark.llm.common import fresh, hex_sha, table, with_rows
from tidemark.llm.shingles import mix

WINDOW, GRAM = 50, 20

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = np.ones(size + 1, np.uint64), np.ones(size + 1, np.uint64)
            np.cumprod(np.full(size, _BASE, np.uint64), out=self.up[1:])
            np.cumprod(np.full(size, _INVERSE, np.uint64), out=self.down[1:])
        return self


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every prefix: sum of byte * base**position."""
    powers = POWERS.upto(len(data) + 1).up
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def hashes_of(prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of the strings of the given length (a number or array) at the given places."""
    return (prefix[start + length] - prefix[start]) * POWERS.down[start]


def byte_units(window: int, gram: int) -> anchored.Units:
    def cut(text: str | None):
        body = (text or "").encode("utf-8", "surrogatepass")
        grams = np.zeros(0, np.uint64)
        if len(body) >= window:
            prefix = prefix_hashes(np.frombuffer(body, np.uint8))
            grams = mix(hashes_of(prefix, np.arange(len(body) - gram + 1), gram))
        return grams, lambda a, b: body[a:b]

    def body(text: str | None):
        whole = (text or "").encode("utf-8", "surrogatepass")
        return lambda a, b: whole[a:b]

    return anchored.Units(window, gram, cut, body)


def single_windows(length: int):
    return lambda body, count: [body[i : i + length] for i in range(count)]


def sort_suffixes(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``place`` by group and then by their first ``length`` bytes."""
    prefix = prefix_hashes(data)
    whole = hashes_of(prefix, place, length)
    head = np.zeros(len(place), np.uint64)
    for k in range(min(8, length)):
        head = (head << np.uint64(8)) | data[place + k]

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each suffix of ``a`` sorts strictly before that of ``b``."""
        unlike = np.flatnonzero(whole[a] != whole[b])
        x, y = place[a[unlike]], place[b[unlike]]
        # Binary search for the length of the common extension.
        low, high = np.zeros(len(x), np.int64), np.full(len(x), length - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = hashes_of(prefix, x, middle) == hashes_of(prefix, y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        less = np.zeros(len(a), bool)
        less[unlike] = data[x + low] < data[y + low]
        return less

    order = np.lexsort((head, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (head[order[1:]] != head[order[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(order))
    base, local = np.repeat(first, size), np.arange(len(order)) - np.repeat(first, size)
    extent = np.repeat(size, size)
    width = 1
    while width < int(size.max(initial=0)):
        # Runs of ``width`` suffixes merge in pairs; each one looks for its place in the other run.
        run = local // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        low, stop = np.minimum(other, extent), np.minimum(other + width, extent)
        at, high = low.copy(), stop.copy()
        while len(live := np.flatnonzero(at < high)):
            middle = (at[live] + high[live]) >> 1
            mine, its = order[live], order[base[live] + middle]
            ahead = np.where(left[live], 0, 1) == 1
            # A left suffix goes before equal right ones.
            moves = np.empty(len(live), bool)
            moves[~ahead] = before(its[~ahead], mine[~ahead])
            moves[ahead] = ~before(mine[ahead], its[ahead])
            at[live] = np.where(moves, middle + 1, at[live])
            high[live] = np.where(moves, high[live], middle)
        start = np.where(left, run, run - 1) * width
        target = base + start + (local - run * width) + (at - low)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def sort_shard(length: int):
    def shard(bodies: list[bytes], anchor, windows, k1, k2, start) -> tuple:
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies], np.int64)
        first = np.cumsum(sizes) - sizes
        windows = windows.astype(np.int64)
        segment = np.repeat(np.arange(len(bodies)), windows)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = first[segment] + offset
        group = np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0)[segment]
        order = sort_suffixes(data, place, group, length)
        strings = np.lib.stride_tricks.sliding_window_view(data, length)
        prefix = prefix_hashes(data)
        whole = hashes_of(prefix, place[order], length)
        same = (whole[1:] == whole[:-1]) & (group[order[1:]] == group[order[:-1]])
        pairs = np.flatnonzero(same)
        for a in range(0, len(pairs), 1 << 16):
            p = pairs[a : a + (1 << 16)]
            if (strings[place[order[p]]] != strings[place[order[p + 1]]]).any():  # a collision
                exact = np.ascontiguousarray(strings[place]).view(f"V{length}").ravel()
                _, code = np.unique(exact, return_inverse=True)
                order = np.argsort(code, kind="stable")
                same = code[order[1:]] == code[order[:-1]]
                break
        string = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(order) else order
        least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(least, string, k1[segment[order]])
        e1 = np.empty(len(order), np.int64)
        e1[order] = least[string]
        # Only the document matters; runs go on while it stays the same.
        return anchored.runs_of(segment, offset, e1, np.zeros_like(e1), offset)

    return shard


def suffix_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = anchored.HOT,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed_spans`` (byte ranges) and ``kept_bytes``."""
    spans = anchored.repeated_spans(
        docs, byte_units(window, gram), sort_shard(window), single_windows(window),
        seen={"low": F.min("k1"), "high": F.max("k1")}, repeats=F.expr("low < high"),
        earlier=lambda e1, e2, at, k1, k2, place: e1 < k1, key=key, text=text, hot=hot,
    )
    (name,) = fresh(docs, "spans")

    def make(columns: list[pa.Array]) -> list:
        sizes, removed, kept = [], [], []
        for value, ranges in zip(*columns):
            body = (value.as_py() or "").encode("utf-8", "surrogatepass")
            gone = anchored.runs_in(anchored.covered(ranges, len(body), window))
            sizes.append(len(body))
            removed.append([{"start": a, "end": b} for a, b in gone])
            edges = [0, *(x for span in gone for x in span), len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return [sizes, removed, kept]

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    made = {"n_bytes": T.LongType(), "removed_spans": T.ArrayType(span), "kept_bytes": T.BinaryType()}
    return with_rows(anchored.with_spans(docs, spans, key, text, name), made, make, text, name).drop(name)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        hex_sha(F.col("kept_bytes")).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], length: int = WINDOW) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> (bytes, removed, spans, kept), for tests."""
    bodies = {k: (t or "").encode() for k, t in rows}
    first: dict[bytes, int] = {}
    for k in sorted(bodies):
        for i in range(len(bodies[k]) - length + 1):
            first.setdefault(bodies[k][i : i + length], k)
    out = {}
    for k, body in bodies.items():
        mask = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < k:
                mask[i : i + length] = True
        kept = bytes(np.frombuffer(body, np.uint8)[~mask])
        out[k] = (len(body), int(mask.sum()), len(anchored.runs_in(mask)), kept)
    return out
