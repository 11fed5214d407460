"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one works on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import language_id, mixing, ngram_join, packing, suffix_dedup
from turnloom.llm.common import table, temporary_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language."""
    return language_id.keep_identified(docs, language_id.train(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur elsewhere before."""
    return suffix_dedup.remove_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, drawn so that all sources weigh the same."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most the capacity in tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: Trained filters, suffix sorting and seeded draws have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages they are a table in the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    path = temporary_table(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{path}/{k}")
            docs = spark.read.parquet(f"{path}/{k}")
    return docs
