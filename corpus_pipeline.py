"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all the rows that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of documents, all others that a table has with
them. Very long texts are read whole in every stage, rows that tie or repeat are treated as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bag_minhash, decontaminate, exact_dedup, packing, quality_pu
from attestor.llm.tables import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold. A null text is scored as an empty one, rows of one
    id each by their own text; an empty table gives an empty one, and no usable label keeps all."""
    return quality_pu.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that of the smallest id. A null text is empty and equals an empty one; null ids come last."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, one row: that of the smallest id. Null ids come last; texts without words are
    near only what equals them."""
    return bag_minhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of them for the most part go. Null and empty texts stay as
    they are, each row is judged by itself."""
    clean = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, with their sequences; a null text is empty and still has its end."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near-duplicate detection", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("best-fit packing", pack),
]

#: The classifier, the signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
