"""Queries of the training-data operators over whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import bag_minhash, chat_repair, decontaminate, exact_dedup, packing, pii, quality_pu, shard_minimax, suffix_dedup, url_rules
from attestor.llm.tables import table


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_minimax.minimax_shards(table(spark, sf_dir, "documents"), 8)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_pu, op2_bag_minhash, op3_suffix_dedup, op4_pii, op5_decontaminate, op6_url_rules, op7_minimax_shards, op8_exact_dedup, op9_best_fit_packing, op10_chat_repair)}
ORACLE_SQL = {"op2_bag_minhash": bag_minhash.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op7_minimax_shards": shard_minimax.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_url_rules": url_rules.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
