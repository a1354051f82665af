"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import id_remainder, table
from wiretide.llm.jaccard_join import one_of_each_group
from wiretide.llm.lang_id import fit_languages, keep_identified
from wiretide.llm.mixing import repeat_documents
from wiretide.llm.packing import pack_documents
from wiretide.llm.quality import fit_quality, keep_good
from wiretide.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of three quarters of the ids."""
    train = id_remainder(F.col("doc_id"), 4) != 2
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels"), train))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; learnt from four fifths of the ids."""
    return keep_identified(docs, fit_languages(docs, id_remainder(F.col("doc_id"), 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training windows; a repeated document is packed as often as it comes."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# Learnt models, hashing and tokens can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
