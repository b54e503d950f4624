"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversations,
    decontamination,
    language_model,
    licenses,
    packing,
    pii,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from .common import table
from .oracles import ORACLES


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_rules(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations")
    return conversations.repaired_summary(conversations.damaged(found), found)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.perplexity_scores(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_pii,
    op2_quality,
    op3_substrings,
    op4_line_rules,
    op5_toxicity,
    op6_packing,
    op7_simhash,
    op8_licenses,
    op9_sharding,
    op10_decontamination,
    op11_spelling,
    op12_conversations,
    op13_language_model,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """For what SQL can express; the others are tested against plain versions."""
    return dict(ORACLES)
