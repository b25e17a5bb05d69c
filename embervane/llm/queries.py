"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embervane.llm import isomedia, oracles, shardtree
from embervane.llm.bpe import encode_documents
from embervane.llm.chatfmt import format_chats
from embervane.llm.decontam import contained_items
from embervane.llm.htmltemplate import extract_slots
from embervane.llm.langmix import identify
from embervane.llm.ngram_join import similarity_classes
from embervane.llm.secretscan import find_secrets
from embervane.llm.tokencount import count_with_edits

#: The placement of op7 before and after one shard's weight grows.
TREE = shardtree.uniform_tree()
GROWN = shardtree.reweighted(TREE, "g1r2s3", 6.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(_table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shardtree.moves(_table(spark, sf_dir, "documents"), TREE, GROWN)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.keyframe_rows(isomedia.multiplexed(_table(spark, sf_dir, "documents")))


def op9_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_slots(_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_benchmark_decontamination, op2_edit_aware_counts, op3_language_mixture, op4_ngram_jaccard_join, op5_chat_formatting, op6_secret_scan, op7_hash_tree_sharding, op8_media_columns, op9_html_templates, op10_byte_bpe)
}

ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": oracles.JACCARD,
    "op7_hash_tree_sharding": shardtree.oracle(TREE, GROWN),
    "op8_media_columns": isomedia.ORACLE,
}
