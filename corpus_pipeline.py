"""From raw documents to packed training windows.

Stages: documents below the quality threshold go; of equal texts one stays; of near-duplicates (five-word shingles,
Jaccard similarity 0.8 or more) one stays; sources are mixed to target weights; what is left is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapelake.llm import exact_dedup, mixture, packing, quality, simhash
from tapelake.llm.common import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, ranker, 0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: Scores, hashes and token ids are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
