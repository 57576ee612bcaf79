"""From raw documents to a training mix: toxicity, quality, near duplicates, benchmark leaks, source weights.

Each stage reads documents and returns documents with the same columns; the last returns each document as often as
the mix takes it, numbered by mix_copy.

Defined results: null texts and texts without words fail the quality rules; of rows equal in id and text one stays; a null id
takes part in every stage; very long texts are judged whole; other columns come through as they were, but for one named
mix_copy in the last stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.decontamination import drop_contaminated
from tessella.llm.mixing import mixed
from tessella.llm.neardup import drop_near_duplicates
from tessella.llm.quality import filter_quality
from tessella.llm.toxicity import filter_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Training a network and MinHash can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
