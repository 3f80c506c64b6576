"""The corpus pipeline: stages that each take the documents their predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents in which
benchmark windows cover a twentieth of the words go, secrets are masked, and what is
left is packed. All stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import fmindex, neardup, packing, secretscan, toxicity
from lumberline.llm.store import importable, stored, unused


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose id was not rejected; rows with a NULL id stay."""
    name = unused(docs, "gone")
    gone = rejected.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns, score = docs.columns, unused(docs, "score")
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, weights, score).filter(F.col(score) < 0.5).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(neardup.near_duplicates(docs, percent=80), "components")
    return _without(docs, found.filter(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    report = fmindex.contamination_report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, stored(report.filter("contaminated"), "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    masked = secretscan.redacted(docs)
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return masked.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
# The stages are not expressible in SQL; the tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
