"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import attention_quality, chat_template, cross_tokenizer, decontamination, jaccard_join, merkle_manifest, pii, sentencepieces, sharding, token_store, topk_search, toxicity, url_filter
from noteloom.llm.common import materialize, table


def op1_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_store.write_shards(table(spark, sf_dir, "documents"))
    return token_store.read_shards(spark, folder, manifest)


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, materialize(url_filter.block_list(pages), "block-list"))


def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_template.with_extra(table(spark, sf_dir, "conversations"))
    return chat_template.read_back(materialize(chat_template.format_conversations(conversations), "formatted"))


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_union_find_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.align(table(spark, sf_dir, "documents"))


def op13_pregel_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.build_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_signature_tree_join": op1_signature_tree_join,
    "op2_noisy_channel_toxicity": op2_noisy_channel_toxicity,
    "op3_pigeonhole_decontamination": op3_pigeonhole_decontamination,
    "op4_minimax_sharding": op4_minimax_sharding,
    "op5_sentencepiece_lattice": op5_sentencepiece_lattice,
    "op6_weak_supervision_pii": op6_weak_supervision_pii,
    "op7_token_sstable": op7_token_sstable,
    "op8_bloom_cascade": op8_bloom_cascade,
    "op9_chat_template": op9_chat_template,
    "op10_pivot_topk": op10_pivot_topk,
    "op11_attention_quality": op11_attention_quality,
    "op12_union_find_alignment": op12_union_find_alignment,
    "op13_pregel_merkle": op13_pregel_merkle,
}

ORACLES: dict[str, str] = {
    "op1_signature_tree_join": jaccard_join.oracle(),
    "op4_minimax_sharding": sharding.oracle(),
    "op8_bloom_cascade": url_filter.oracle(),
    "op9_chat_template": chat_template.oracle(),
    "op10_pivot_topk": topk_search.oracle(),
    "op13_pregel_merkle": merkle_manifest.oracle(),
}
