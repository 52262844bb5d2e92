"""From raw documents to token ids: the corpus pipeline.

Toxic documents go, then exact copies, near copies and documents that hold a benchmark passage; what
is left is encoded. Of copies and near copies one row stays, also where rows are repeated or have no
doc_id. Every stage but the last returns the columns of ``documents``, whatever they are called; each
works on all rows the one before it kept, which are written in between. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import decode, encode
from tidemark.llm.common import fresh, table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.toxicity import score_toxicity, train


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text renamed.

    An operator replaces columns named like its own; a stage hands the columns of documents through.
    """
    return docs.select(
        *[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`{c}`").alias(f"documents_{c}") for c in docs.columns]
    )


def kept_rows(found: DataFrame, docs: DataFrame, keep: Column | str) -> DataFrame:
    """The columns of ``docs`` of the rows to keep, ``found`` being made from ``shielded(docs)``."""
    return found.where(keep).select(
        *[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`documents_{c}`").alias(c) for c in docs.columns]
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return kept_rows(score_toxicity(shielded(docs), model), docs, "not toxic")


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``shielded(docs)`` with a key of its own for every row, and the key's name.

    Keys sort by doc_id (null last), then by the place of the row in the files of ``docs``, which
    stays the same however often they are read. What is not read from files is written first.
    """
    (key,) = fresh(docs, "row_key")

    def with_key(rows: DataFrame) -> DataFrame:
        place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *place).alias(key)
        return shielded(rows.withColumn(key, place)).withColumnRenamed(f"documents_{key}", key)

    try:
        return with_key(docs), key
    except AnalysisException:
        return with_key(written(docs, "keyed")), key


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return kept_rows(exact_dedup(rows, key=key), docs, "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class stays."""
    rows, key = keyed(docs)
    return kept_rows(near_duplicates(rows, key=key), docs, F.col("class_id").eqNullSafe(F.col(key)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(shielded(docs), table(spark, sf_dir, "benchmark"))
    return kept_rows(found, docs, "size(hit_spans) = 0")


# Rows of an Arrow batch in the last stage, where two Python workers stand one behind the other.
BATCH_ROWS = "1000"


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text again.

    Sets the session's rows per Arrow batch: whole texts and their ids wait in each of two workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return decode(encode(docs)).select(
        "doc_id",
        "source",
        "lang",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", tokens),
]

# Toxicity and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
