"""The registered queries of the operators in this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, filter_audit, language_id, lm_scoring, near_dedup, quality_rules, sentencepiece_codec, sharding, source_audit, substring_dedup, token_counts, toxicity
from . import oracle
from .common import read_table


def op1_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), held_out_mod=7, held_out_rest=2)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=24)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(read_table(spark, sf_dir, "documents"), n_words=5, threshold=0.8)


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"), held_out_mod=4, held_out_rest=2)


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(read_table(spark, sf_dir, "documents"))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"), min_words=50)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(read_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_backoff_score, op2_toxicity_chain, op3_jump_shards, op4_sentencepiece, op5_token_counts,
        op6_bagminhash_classes, op7_language_mixture, op8_divergence_rules, op9_simhash_windows, op10_repeated_passages,
        op11_source_audit, op12_exact_dedup, op13_filter_audit,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_source_audit": oracle.SOURCE_AUDIT, "op12_exact_dedup": oracle.EXACT_DEDUP, "op13_filter_audit": oracle.FILTER_AUDIT}
