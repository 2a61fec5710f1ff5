"""A corpus pipeline of four stages: language ID, toxicity, near duplicates, packing.

Each stage takes the documents that the one before kept. A stage that filters returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm.common import cut_lineage, table
from leadweave.llm.language import identify, learn_profiles
from leadweave.llm.near_duplicates import one_of_each
from leadweave.llm.packing import pack_documents
from leadweave.llm.toxicity import labelled, learn_weights, score_texts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any language (null, or no letters); a missing lang becomes the predicted one."""
    found = identify(docs, learn_profiles(docs)).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier toxic than not; learns from the labels of those it is given."""
    weights = learn_weights(labelled(docs, table(spark, sf_dir, "labels")))
    return score_texts(docs, weights).filter("score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each class of near duplicates."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document's pieces in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]

#: SQL cannot express the learned stages; tests/llm compares them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
