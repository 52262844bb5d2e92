"""Removal of repeated word passages with a compressed full-text index per shard.

A window is 20 consecutive words. Every word covered by a window whose words also start earlier (a
smaller doc_id, or the same document further on the left) is removed; windows are judged on the
input. Segments of text that may repeat go to shards by content (see ``anchored``). A shard's
segments are numbered by its own vocabulary and indexed: a suffix-sorted transform in a wavelet
matrix of packed bits. All windows of the shard are streamed against it by backward search, an
interval of one occurrence being given up at once, and the occurrences of those that repeat are
located by sampled suffix positions; the earliest of each is kept.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null texts have none. Of repeated rows with one doc_id
those with equal texts are the same document, others are ordered by the hash of their text. A null
doc_id comes before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import anchored
from tidemark.llm.common import fresh, hex_sha, table, with_rows
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.shingles import shingles, word_hashes, words_of

WINDOW, GRAM = 20, 8


def word_units(window: int, gram: int) -> anchored.Units:
    def cut(text: str | None):
        words = words_of(text)
        grams = shingles(word_hashes(words), gram) if len(words) >= window else np.zeros(0, np.uint64)
        return grams, lambda a, b: b" ".join(words[a:b])

    def body(text: str | None):
        words = words_of(text)
        return lambda a, b: b" ".join(words[a:b])

    return anchored.Units(window, gram, cut, body)


def single_windows(length: int):
    def window(body: bytes, count: int) -> list[bytes]:
        words = body.split(b" ")
        return [b" ".join(words[i : i + length]) for i in range(count)]

    return window


def index_shard(length: int):
    def shard(bodies: list[bytes], anchor, windows, k1, k2, start) -> tuple:
        vocabulary: dict[bytes, int] = {}
        ids, sizes = [], []
        for body in bodies:
            words = body.split(b" ")
            sizes.append(len(words))
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            ids.append(0)
        text = np.array(ids, np.int64)
        first = np.cumsum(np.array(sizes) + 1) - np.array(sizes) - 1
        index = FMIndex(text, len(vocabulary) + 1)
        windows = windows.astype(np.int64)
        segment = np.repeat(np.arange(len(bodies)), windows)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        # The earliest occurrence of every window as far as its own segment tells.
        e1, e2, at = k1[segment].copy(), k2[segment].copy(), start[segment] + offset
        place = first[segment] + offset
        low, high = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
        step = 1 << 15
        for a in range(0, len(segment), step):
            patterns = text[place[a : a + step, None] + np.arange(length)]
            low[a : a + step], high[a : a + step] = index.search(patterns, least=2)
        again = np.flatnonzero(high > low)
        if len(again):
            starts, which = np.unique(low[again], return_inverse=True)
            ends = np.zeros(len(starts), np.int64)
            ends[which] = high[again]
            many = ends - starts
            group = np.repeat(np.arange(len(starts)), many)
            row = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            found = index.locate(row)
            owner = np.searchsorted(first, found, side="right") - 1
            far = start[owner] + found - first[owner]
            order = np.lexsort((far, k2[owner], k1[owner], group))
            best = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
            e1[again], e2[again], at[again] = k1[owner[best]][which], k2[owner[best]][which], far[best][which]
        return anchored.runs_of(segment, offset, e1, e2, at)

    return shard


def substring_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    gram: int = GRAM,
    hot: int = anchored.HOT,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (words left, one space between)."""

    def before(e1, e2, at, k1, k2, place):
        return (e1 < k1) | ((e1 == k1) & ((e2 < k2) | ((e2 == k2) & (at < place))))

    spans = anchored.repeated_spans(
        docs, word_units(window, gram), index_shard(window), single_windows(window),
        seen={"many": F.max("many")}, repeats=F.expr("n > 1 or many"), earlier=before, key=key, text=text, hot=hot,
    )
    (name,) = fresh(docs, "spans")

    def make(columns: list[pa.Array]) -> list:
        sizes, removed, kept = [], [], []
        for value, ranges in zip(*columns):
            words = words_of(value.as_py())
            mask = anchored.covered(ranges, len(words), window)
            sizes.append(len(words))
            removed.append(int(mask.sum()))
            left = [w for w, gone in zip(words, mask.tolist()) if not gone] if removed[-1] else words
            kept.append(b" ".join(left).decode("utf-8", "replace"))
        return [sizes, removed, kept]

    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}
    return with_rows(anchored.with_spans(docs, spans, key, text, name), made, make, text, name).drop(name)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", hex_sha(F.col("kept_text")).alias("kept_sha256")
    )


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW} - 1], ' ') AS p
        FROM w, unnest(range(1, len(w) - {WINDOW} + 2)) AS u(s) WHERE len(w) >= {WINDOW}),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT s + k) AS g FROM late, unnest(range(0, {WINDOW})) AS v(k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
       sha256(coalesce(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE
         (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i) AS t
          WHERE NOT list_contains(g, i)) END, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
