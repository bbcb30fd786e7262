"""The corpus pipeline: documents to shards in five stages, each written before the next reads it.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last return the
columns of ``docs``.

1. ``quality``: documents that the quality classifier scores below its threshold go.
2. ``near_duplicates``: of each group of documents linked by a shingle similarity of 0.75 or
   more, the one with the smallest ``doc_id`` stays.
3. ``decontamination``: documents that contain a benchmark item go.
4. ``mixing``: each document is repeated by a Poisson draw with its source's target rate, and
   rows are dealt at random. Repetitions keep their ``doc_id``.
5. ``sharding``: rows get a shard and a slot along a Hilbert curve over their metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reliefsignals.llm import decontaminate, jaccard, mixing, quality, sharding
from reliefsignals.llm.bounds import written
from reliefsignals.llm.queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_quality(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(spark, docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Neither a trained classifier nor hashed sketches can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents``; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
