"""Benchmark decontamination with a full-text index per training shard.

Each Arrow batch of documents is a shard. Its words are mapped to the benchmark's vocabulary, and
the stretches that could hold a test phrase (runs of word pairs that some benchmark item has) are
indexed: a suffix-sorted transform in a wavelet matrix. Test phrases are looked up by backward
search, their occurrences located by sampled suffix positions, and the spans merged per document.
Documents are read once and never shuffled; the benchmark goes through in blocks of bounded size,
one pass of the rows through Python per block.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. A phrase is
``window`` consecutive words of an item, or the whole of a shorter one; items without words have
none. Null texts have no words. Repeated items count once by item_id; a null item_id counts as an
item and shows as an empty string.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, hex_sha, table, with_rows
from tidemark.llm.fm_index import FMIndex

WINDOW = 10
# Bytes of benchmark text in one block; a block is what a task holds at once.
BLOCK_BYTES = 32 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FOLD = bytes(b if b in _WORD else 0x20 for b in _FOLD)

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """The phrases of one block of benchmark items, as numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for start in range(max(1, len(words) - window + 1)) if words else ():
                owners[tuple(words[start : start + window])].add(item)
        self.symbols = len(self.vocabulary) + 1
        by_length = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.by_length = {
            n: (np.array(p, np.int64), [sorted(owners[x]) for x in p]) for n, p in by_length.items()
        }
        self.shortest = min(by_length, default=0)
        pairs = {p for phrase in owners for p in zip(phrase, phrase[1:])}
        self.pairs = np.sort(np.array([a * self.symbols + b for a, b in pairs] or [-1], np.int64))

    def stretches(self, ids: np.ndarray) -> np.ndarray:
        """Which words lie in a run long enough for the shortest phrase."""
        if self.shortest <= 1:
            return ids > 0
        near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[near] * self.symbols + ids[near + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        linked = np.zeros(len(ids) + 1, np.int8)
        linked[near[self.pairs[at] == code] + 1] = 1  # linked[i]: words i-1 and i are a known pair
        edge = np.diff(linked, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest - 1
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, starts[long], 1)
        np.add.at(mark, ends[long] + 1, -1)
        return np.cumsum(mark)[:-1] > 0

    def occurrences(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, list[list[str]]]]:
        """(length, start positions, phrase numbers, owners) of all phrases found in ``ids``."""
        if not self.shortest or not len(ids):
            return []
        inside = np.flatnonzero(self.stretches(ids))
        if not len(inside):
            return []
        # Stretches one behind the other, with a separator after each.
        gap = np.flatnonzero(np.diff(inside) > 1) + 1
        text = np.append(np.insert(ids[inside], gap, 0), 0)
        origin = np.append(np.insert(inside, gap, -1), -1)
        index = FMIndex(text, self.symbols)
        found = []
        for length, (patterns, owners) in self.by_length.items():
            low, high = index.search(patterns)
            many = high - low
            phrase = np.repeat(np.arange(len(patterns)), many)
            row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            if len(row):
                found.append((length, origin[index.locate(row)], phrase, owners))
        return found


def _match(phrases: Phrases):
    """Documents of one batch to (words, spans, items), the latter merged with those so far."""

    def make(columns: list[pa.Array]) -> list:
        texts, spans_before, items_before = columns
        # id 0 stands for any other word and, once after each document, for its end.
        parts, counts = [], []
        for text in texts:
            words = words_of(text.as_py())
            counts.append(len(words))
            parts.append(np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        counts = np.array(counts, np.int64)
        starts = np.cumsum(counts + 1) - counts - 1
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        edge = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for length, at, phrase, owners in phrases.occurrences(ids):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0).tolist():
                items[d].update(owners[p])
        for d, before in enumerate(spans_before):
            for span in before.as_py() or ():
                edge[starts[d] + span["start"]] += 1
                edge[starts[d] + span["end"]] -= 1
        hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
        change = np.diff(hit)
        begins, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        doc = np.searchsorted(starts, begins, side="right") - 1
        spans: list[list] = [[] for _ in counts]
        for d, b, e in zip(doc.tolist(), (begins - starts[doc]).tolist(), (stops - starts[doc]).tolist()):
            spans[d].append({"start": b, "end": e})
        merged = [
            sorted({*(before.as_py() or ()), *items.get(d, ())}) for d, before in enumerate(items_before)
        ]
        return [counts.tolist(), spans, merged]

    return make


def blocks(bench: DataFrame, key: str, text: str, size: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks of at most ``size`` bytes (one item at least), a block at a time."""
    found, now, used = [], [], 0
    rows = bench.select(F.coalesce(F.col(key).cast("string"), F.lit("")), text)
    for item, words in rows.toLocalIterator():
        heavy = len(words or "")
        if now and used + heavy > size:
            found.append(now)
            now, used = [], 0
        now.append((item, words))
        used += heavy
    return [*found, now]


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged word ranges) and ``hit_items`` (as strings)."""
    columns = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType())}
    source, = fresh(docs, "source_text") if text.lower() in columns else (text,)
    out = docs.withColumn(source, F.col(text)) if source != text else docs
    out = out.withColumns({n: F.lit(None).cast(t) for n, t in columns.items()})
    for block in blocks(bench, item, item_text, block_bytes):
        out = with_rows(out, columns, _match(Phrases(block, window)), source, "hit_spans", "hit_items")
    return out.drop(source) if source != text else out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        hex_sha(F.array_join("hit_items", ",")).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS p, least(len(w), {WINDOW}) AS n
  FROM item, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS u(s) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
size AS (SELECT DISTINCT n FROM phrase),
gram AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p
  FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n),
hit AS (SELECT doc_id, item, s, n FROM gram JOIN phrase USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(0, n)) AS v(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
