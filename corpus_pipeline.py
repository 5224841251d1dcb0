"""The training-data pipeline: five operators over ``documents``, one after the other.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns the columns of ``documents`` (the last one: packed sequences). ``run`` writes
each stage's result as Parquet below the shared folder and rereads it for the next.

Cases: null texts and null identifiers pass through every filter; rows of one identifier
count as one document and stay or go together; empty tables stay empty; extra columns,
also those named like an operator's own, are carried to the last stage, whose result has
the packed sequences only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelwork.llm import decontaminate as contamination
from wheelwork.llm import jaccard, packing, repeats
from wheelwork.llm import toxicity as toxic
from wheelwork.llm.common import drop_written, put_back, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not find toxic (score below 0.5)."""
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return put_back(toxic.score(docs, model).where("toxicity < 0.5"), docs, toxic.OUTPUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest identifier, of each group linked at 0.8 over five-word shingles."""
    found = jaccard.near_duplicates(docs, k=5, num=4, den=5)
    gone = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("first")).where("NOT first").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 50 bytes or more that an earlier document has."""
    out = repeats.without_repeats(docs, as_text=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept"))
    return put_back(out, docs, repeats.OUTPUT, text=text, n_chars=F.char_length(text).cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    out = contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = out.where("text IS NULL OR clean_text IS NOT NULL")
    text = F.col("clean_text")
    return put_back(kept, docs, contamination.OUTPUT | contamination.REMOVED, text=text, n_chars=F.char_length(text).cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens with the pieces of documents in them."""
    out = packing.pack(docs)
    return out.select("sequence_id", "n_tokens", "padded_to", F.array_distinct(F.col("pieces.doc_id")).alias("doc_ids"), "pieces", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
#: A factorization machine and least squares are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_written(before)
    return docs
