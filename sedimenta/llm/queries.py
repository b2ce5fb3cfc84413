"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import chat, compression, decontaminate, mixing, pages, rules, simhash, substrings, toxicity, urls
from sedimenta.llm.tables import table


#: Byte-level vocabulary as tiktoken ranks. None: tokens are bytes.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str, tokenizer: str | None = TOKENIZER) -> DataFrame:
    ranks = Path(tokenizer).read_bytes() if tokenizer else None  # under 1 MB, sent with the task
    said = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS bigint) AS conv_id", "cast(turn AS bigint) AS turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], said.schema)
    return chat.read_back(chat.packs(said.unionAll(more), ranks), ranks)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.fit(spark))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut(table(spark, sf_dir, "documents")).selectExpr("doc_id", "_n_words AS n_words", "_n_removed AS n_removed", "_kept_sha256 AS kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_fold=1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_fold=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_prefix_tree,
        op2_url_filter,
        op3_substring_dedup,
        op4_mixing,
        op5_simhash_near_dedup,
        op6_benchmark_decontamination,
        op7_toxicity,
        op8_quality_rules,
        op9_page_text,
        op10_compression_quality,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.ORACLE_SQL,
}
