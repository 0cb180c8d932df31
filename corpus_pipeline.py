"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet to the cluster's shared folder and read again as the next one's documents. Null and empty
texts, texts of any length, ties, repeated rows and columns of other names are handled as the stages' operators say; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filamenta.llm import mixing, packing, secrets, simhash, toxicity
from filamenta.session import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half stay; the models learn from the labelled documents."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component stays."""
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A calibrated sample whose token shares by source, language and topic meet the targets."""
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The models of the first stage and the tokenizer of the last are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
