"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage but the last returns the columns of documents: quality rules, language identification and near-duplicate removal drop rows, the secret scan masks what it
finds in the texts, and packing returns the pieces of the sequences that a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandworks.llm import common, language, near_copies, packing, quality, secrets
from strandworks.llm.token_ids import vocabulary


#: Texts of fewer words are rejected. Packing puts short texts together, so being short is no defect here; having no word is.
LEAST_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return quality.filter_documents(docs, LEAST_WORDS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter or without a language of at least half their words; learns from the documents' own lang."""
    return language.filter_documents(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies: 5-word shingles of a Jaccard similarity of 0.8 or more."""
    return near_copies.filter_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; keeps every document."""
    return secrets.mask_documents(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' ids into sequences of at most 2048."""
    common.prepare(spark)
    return packing.pack_documents(docs, vocabulary(), 1)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: No SQL states the models of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder of tables."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
