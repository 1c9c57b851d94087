"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. quality rules: documents that the base limits or a certified rule reject go
2. line dedup: later repeated runs of lines are deleted; documents of which nothing is left go
3. SimHash near-dedup on five-word shingles: the smallest id of each group stays
4. secret scan: secrets found are replaced in the texts
5. packing: the texts become pieces of token sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlefold.llm import linededup, packing, quality, secrets, simhash
from candlefold.llm.common import ship_package, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.strip(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs, earlier=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL has no XXH64, no byte-level BPE and no greedy packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
