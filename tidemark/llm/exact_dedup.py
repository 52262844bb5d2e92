"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Texts are equal when they are identical after every blank (space, \\t, \\n, \\v, \\f, \\r) is
deleted. Rows are narrowed in steps: by the normalised length, then by a hash of the first
characters, and only texts that still have a partner have their full content hashed. All steps are
DataFrame functions. Groups are keyed by content and never gathered: each is a count and two
extremes.

Null texts count as empty, and all empty texts are one group. Repeated rows are members like any
other (one output row each); if rows with the same doc_id tie, all of them stay. A null doc_id
sorts last. Columns of the input are kept; those named like the new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, content, fresh, hex_sha, small, table, written

# Characters the prefix hash reads, and groups up to which the table of groups may be broadcast.
PREFIX = 64
GROUPS = 200_000


def normalised(column: Column) -> Column:
    return reduce(lambda text, blank: F.replace(text, F.lit(blank), F.lit("")), BLANKS, column)


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    prefix: int = PREFIX,
    digest: str | None = None,
) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    key. ``digest`` names a column for the SHA-256 of every normalised text; without it only texts
    that may have a partner are hashed in full.
    """
    length, head, full, chars, best, twin = fresh(docs, "len", "head", "full", "chars", "best", "twin")
    norm = normalised(content(text))
    sized = {length: F.octet_length(norm), head: F.xxhash64(F.substring(norm, 1, prefix))}

    # Lengths that more than one text has, then (length, prefix hash) pairs: fixed-width counts.
    slim = docs.select(text).withColumns(sized).select(length, head)
    lengths = slim.groupBy(length).agg(F.count("*").alias("n")).where("n > 1").select(length)
    heads = (
        slim.groupBy(length, head)
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .join(lengths, length, "left_semi")
        .select(length, head, F.lit(True).alias(twin))
    )
    heads = small(written(heads, "dedup-heads"))

    def hashed(frame: DataFrame) -> DataFrame:
        """With the full hash where the prefix has a partner (everywhere if a digest is wanted)."""
        sha = hex_sha(norm)
        return frame.withColumns(sized | {chars: F.length(content(text))}).join(
            heads, [length, head], "left"
        ).withColumn(full, sha if digest else F.when(F.col(twin), sha))

    members = hashed(docs.select(key, text)).where(F.col(twin)).select(length, head, full, key, chars)
    # The smallest key of each number of code points, then the largest number; again fixed width.
    longest = members.groupBy(length, head, full).agg(
        F.count("*").alias("group_size"), F.max(chars).alias(chars)
    )
    first = members.groupBy(length, head, full, chars).agg(F.min(key).alias("keep_id"))
    groups = (
        longest.where("group_size > 1")
        .join(first, [length, head, full, chars])
        .select(length, head, full, F.col(chars).alias(best), "keep_id", "group_size")
    )
    groups = small(written(groups, "dedup-groups"), GROUPS)
    new = {"keep_id", "group_size", "kept", *([digest] if digest else [])}
    rest = [c for c in docs.columns if c.lower() not in new]
    alone = F.col("group_size").isNull()
    stays = F.col("keep_id").eqNullSafe(F.col(key)) & (F.col(chars) == F.col(best))
    return (
        hashed(docs.select(*dict.fromkeys([*rest, key, text])))
        .join(groups, [length, head, full], "left")
        .select(
            *rest,
            F.when(alone, F.col(key)).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | stays).alias("kept"),
            *([F.col(full).alias(digest)] if digest else []),
        )
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup(docs, digest="text_sha256")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha AS text_sha256
FROM t WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id)
"""
