"""Corpus queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import math

import corpus_pipeline
import duckdb
import oracle
import pytest
from conftest import SMALL

from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, toxicity
from tidemark.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    columns, rows = oracle.spark_rows(QUERIES[name](spark, SMALL))
    want_columns, want_rows, _ = oracle.sql_rows(duck, ORACLES[name])
    assert (columns, rows) == (want_columns, want_rows)


# Whitening has a row per component; its own tests compare all of them.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op12_whitening"}))
def test_whole_table(spark, name):
    source = "pages" if "html" in name else "documents"
    assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{source}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if number == len(corpus_pipeline.STAGES) - 1:
            rows = out.collect()
            assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
            break
        assert out.columns == docs.columns
        if "Jaccard" in name:
            want = jaccard_join.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])
            assert {r["doc_id"] for r in out.collect()} == {k for k, (c, _) in want.items() if c == k}
        docs = corpus_pipeline.written(out, "stage")


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
@pytest.mark.parametrize("in_files", [True, False])
def test_pipeline_keeps_one_of_repeated_rows(spark, stage, in_files):
    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcd"]
    rows = [(1, texts[0])] * 3 + [(None, texts[1])] * 2 + [(None, texts[2]), (7, texts[2]), (8, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = corpus_pipeline.written(docs, "rows") if in_files else docs
    found = sorted(map(tuple, stage(spark, docs, SMALL).collect()), key=lambda r: r[1])
    assert found == [(1, texts[0]), (None, texts[1]), (7, texts[2]), (None, texts[3])]


CLASHING = "kept toxic severity p_toxic class_id n_links n_linked_texts hit_spans n_words row_key keep_id".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_pipeline_stages_keep_clashing_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    marked = corpus_pipeline.written(marked, "marked")
    out = stage(spark, marked, SMALL)
    assert out.columns == marked.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, docs, SMALL).select("doc_id").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages_on_an_empty_table(spark, name, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    assert stage(spark, corpus_pipeline.written(docs, "empty"), SMALL).count() == 0


def test_pipeline_toxicity_stage_by_the_scores(spark):
    """What goes is what the model, applied row by row without Spark, gives an odds of half or more."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    known = toxicity.WordBuckets()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        bucket, value = toxicity.features(text, known)
        score = sum(model.weights[b] * v for b, v in zip(bucket, value))
        if 1 / (1 + math.exp(model.thresholds[0] - score)) < 0.5:
            want.append(doc_id)
    out = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
    assert 0.5 * docs.count() < len(want) < docs.count()


def test_sample_of_labelled_rows_is_bounded(spark):
    """One labelled doc_id repeated, with several texts: one row of the sample, always the same."""
    docs = spark.range(2000).selectExpr("7L AS doc_id", "concat('text ', id % 5) AS text", "1 AS toxic")
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.labelled(docs, labels, sample=20).collect()] == [("text 0", 2)]


def test_pipeline_exact_and_benchmark_stages_by_sql(spark, duck):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for stage, name, kept in (
        (corpus_pipeline.drop_copies, "op2_exact_dedup", "kept"),
        (corpus_pipeline.drop_contaminated, "op8_decontaminate", "NOT contaminated"),
    ):
        want = duck.execute(f"SELECT doc_id FROM ({ORACLES[name]}) WHERE {kept}").fetchall()
        assert sorted(r["doc_id"] for r in stage(spark, docs, SMALL).collect()) == sorted(r[0] for r in want)
