"""Removal of boilerplate lines by the number of sites they are on.

The spread of a line is the number of distinct sites (column ``source``) that have it. HyperLogLog
sketches of the sites, one per line hash, are built on the map side and merged by aggregation, so a
line on a third of all pages is a few bytes per task. Lines clearly at or above ``min_sites`` are
boilerplate; those whose estimate is within the sketch's error of the threshold get an exact
distinct count. Boilerplate lines are then removed from every document.

Lines are split at \\n and compared without blanks at their ends; a line of blanks only is never
boilerplate. A null source is no site. Null texts count as empty (one empty line). Rows are treated
one by one, so repeated rows and ties change nothing. Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, content, fresh, hex_sha, small, table, written

MIN_SITES = 8
LOG_SIZE = 11
# Standard errors of the sketch around the threshold within which lines are counted exactly.
BAND = 5.0


def line_key(line: Column) -> Column:
    trimmed = F.trim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2"))


def boilerplate(docs: DataFrame, text: str, site: str, min_sites: int, log_size: int = LOG_SIZE) -> DataFrame:
    """(h1, h2) of the lines on at least ``min_sites`` sites."""
    lines = (
        docs.where(F.col(site).isNotNull())
        .select(F.col(site).cast("string").alias("site"), F.explode(F.split(content(text), "\n")).alias("line"))
        .where(F.trim("line", F.lit(BLANKS)) != "")
        .select("site", line_key(F.col("line")).alias("k"))
        .select("site", "k.*")
    )
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_size))).alias("sites")
    )
    band = max(1, math.ceil(BAND * 1.04 / math.sqrt(2**log_size) * min_sites))
    spread = written(spread.where(F.col("sites") >= min_sites - band), "line-spread")
    sure = spread.where(F.col("sites") >= min_sites + band).select("h1", "h2")
    near = small(spread.where(F.col("sites") < min_sites + band).select("h1", "h2"))
    exact = (
        lines.join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("h1", "h2")
    )
    return written(sure.unionAll(exact), "boilerplate")


def line_dedup(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, log_size: int = LOG_SIZE
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``kept_text`` (the lines left)."""
    h1, h2, gone = fresh(docs, "h1", "h2", "gone")
    found = small(boilerplate(docs, text, site, min_sites, log_size))
    # Lines to remove are found once per text and joined back to all rows that have it.
    same = (F.xxhash64(content(text)), F.xxhash64(F.lit(1), content(text)))
    removed = (
        docs.select(
            same[0].alias(h1), same[1].alias(h2), F.posexplode(F.split(content(text), "\n")).alias("at", "line")
        )
        .select(h1, h2, "at", line_key(F.col("line")).alias("k"))
        .join(found.select(F.struct("h1", "h2").alias("b")), F.col("k") == F.col("b"), "left_semi")
        .groupBy(h1, h2)
        .agg(F.collect_set("at").alias(gone))
    )
    new = {"n_lines", "n_removed", "kept_text"}
    rest = [c for c in docs.columns if c.lower() not in new]
    lines = F.split(content(text), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.transform(places, lambda at: F.get(lines, at))
    return (
        docs.withColumns({h1: same[0], h2: same[1]})
        .join(removed, [h1, h2], "left")
        .select(
            *rest,
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_removed"),
            F.when(F.col(gone).isNull(), content(text)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", hex_sha(F.col("kept_text")).alias("kept_sha256"))


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
  FROM documents),
b AS (SELECT {_TRIM.format("line")} AS t FROM l GROUP BY t
      HAVING t <> '' AND count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (t IS NOT NULL) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (t IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON {_TRIM.format("line")} = t GROUP BY doc_id
"""
