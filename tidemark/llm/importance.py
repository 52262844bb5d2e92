"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams are estimated: one of target text
(documents labelled as good), one of all raw text. A document's weight is the log ratio of its
probability under both, summed over its n-grams. Adding Gumbel noise and taking the largest keys
draws documents without replacement in proportion to their weights. The noise is a hash of doc_id,
so a result can be repeated.

The raw model counts every document, the target model every document labelled as good; only their
fixed-size tables of bucket counts come to the driver. The number kept is ``share`` of all rows, found exactly by digits of the key, without a
global sort; ties go to the smaller doc_id (null last), and rows equal in both share their fate up
to the number left. Null and empty texts have no n-grams and a weight of 0. Labels without doc_id or
quality are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, small, table, with_rows, written
from tidemark.llm.shingles import mix, word_hashes

BUCKETS = 10_000
SHARE = 0.85
SMOOTHING = 1.0


_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words, runs of signs, and neighbouring pairs of a text."""
    hashes = word_hashes(_TOKENS.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    return (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(ngram_buckets(value.as_py(), buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in rows.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log probability under the target less that under the raw model, per bucket.

    The target is smoothed towards the raw model, so buckets it has not seen do not decide.
    """
    p_raw = (raw + 1e-3) / (raw + 1e-3).sum()
    p_target = (target + SMOOTHING * len(raw) * p_raw) / (target.sum() + SMOOTHING * len(raw))
    return np.log(p_target) - np.log(p_raw)


def cut_at(rows: DataFrame, column: str, count: int) -> tuple[int | None, int]:
    """The ``count``-th largest value of a long column, and how many rows are larger.

    16 bits are settled at a time, so at most 65,536 counts come to the driver.
    """
    if count <= 0:
        return None, 0
    above, low = 0, None
    rows = rows.select((F.col(column).bitwiseXOR(F.lit(-(2**63)))).alias("u"))  # unsigned order
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("u", shift)
        inside = rows if shift == 48 else rows.where(F.shiftrightunsigned("u", shift + 16) == prefix)
        counts = {
            r["d"]: r["n"]
            for r in inside.groupBy(digit.bitwiseAND(F.lit(0xFFFF)).alias("d")).agg(F.count("*").alias("n")).collect()
        }
        for value in sorted(counts, reverse=True):
            if above + counts[value] >= count:
                break
            above += counts[value]
        else:
            return None, above
        prefix = (prefix << 16) | value
        low = prefix
    return low - 2**63, above


def select_by_importance(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    share: float = SHARE,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_key`` and ``kept``."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    target = docs.join(small(written(good, "good")), key, "left_semi")
    ratio = log_ratio(bucket_counts(target, text, buckets), bucket_counts(docs, text, buckets))

    def make(columns: list[pa.Array]) -> list:
        weights, keys = [], []
        ids = columns[1].cast(pa.int64()).fill_null(-1).to_numpy().astype(np.uint64)
        noise = mix(ids + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)).astype(np.float64)
        gumbel = -np.log(-np.log((noise + 0.5) / 2.0**64))
        for value, g in zip(columns[0], gumbel.tolist()):
            weight = float(ratio[ngram_buckets(value.as_py(), buckets)].sum())
            weights.append(weight)
            keys.append(weight + g)
        # A long that sorts like the key.
        bits = np.array(keys, np.float64).view(np.int64)
        return [weights, keys, np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).tolist()]

    (rank,) = fresh(docs, "rank")
    columns = {"log_weight": T.DoubleType(), "sample_key": T.DoubleType(), rank: T.LongType()}
    scored = with_rows(docs, columns, make, text, key)
    slim = written(scored.select(key, rank), "keys")
    count = round(share * slim.count())
    edge, above = cut_at(slim, rank, count)
    # Of the rows at the edge the smaller keys, as many as are left.
    tied = slim.where(F.col(rank) == F.lit(edge)).select((-F.coalesce(F.col(key).cast("long"), F.lit(2**62))).alias("k"))
    last, _ = cut_at(tied, "k", count - above)
    taken = (F.col(rank) > F.lit(edge)) | (
        (F.col(rank) == F.lit(edge)) & (-F.coalesce(F.col(key).cast("long"), F.lit(2**62)) >= F.lit(last))
    )
    if edge is None:
        taken = F.lit(count > 0)
    return scored.withColumn("kept", taken).drop(rank)


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = select_by_importance(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"), "kept"
    )
