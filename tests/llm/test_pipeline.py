"""Each stage of the pipeline on odd tables: nulls, empty, repeated rows, clashing and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
CLASHING = ["toxicity", "kept", "spans", "n_bytes", "hits", "items", "n_words", "n_hit", "coverage", "contaminated", "clean_text", "shared", "Component_ID"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    odd = table.limit(6).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "")).unionAll(table.limit(2)).unionAll(table.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    out = table.unionAll(odd)
    for i, name in enumerate(CLASHING):
        out = out.withColumn(name, F.lit(i) + F.coalesce(F.col("doc_id"), F.lit(0)))
    return out.withColumn("extra", F.array(F.lit("x")))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_columns_carried(spark, docs, name, stage):
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        for i, c in enumerate(CLASHING):
            assert r[c] == i + (r["doc_id"] or 0)
        assert r["extra"] == ["x"]
    assert any(r["doc_id"] is None for r in rows) and any(r["text"] is None for r in rows)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), DATA).count() == 0
