"""One registered query per operator: the operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reliefsignals.llm import (
    audit,
    bpe,
    chat,
    decontaminate,
    fingerprints,
    jaccard,
    licences,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    suffixes,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark, table(spark, sf_dir, "conversations"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(spark, table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(spark, table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mixed(table(spark, sf_dir, "documents"))
    return mixture.select("doc_id", "source", "copy", "mix_key", "lang", "n_chars", "text")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(spark, table(spark, sf_dir, "documents"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(spark, table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(spark, table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_chat_formatting,
        op3_licence_scan,
        op4_quality_classifier,
        op5_suffix_dedup,
        op6_fingerprints,
        op7_source_mixing,
        op8_jaccard_join,
        op9_hilbert_sharding,
        op10_decontamination,
        op11_bpe_coding,
        op12_merkle_manifest,
        op13_filter_audit,
    )
}
