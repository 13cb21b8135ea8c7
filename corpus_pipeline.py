"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import boosting, fertility, minhash, packing
from shelfwise.llm.common import stored, table


def keep_classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality forest, fitted on the labels that are not held out, does not reject: all rows, all columns.

    Null and empty texts are judged by statistics of zero. Repeated rows are judged alike and so stay or go together. Null ids count
    as any others. Without labels of both classes all is kept unless all labels are 0. An empty table gives no rows.
    """
    forest = boosting.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(boosting.predicted_quality(forest)(F.col("text")) == 1)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fertility bands: all rows, all columns.

    Null and empty texts have under 50 words and go; texts of any length are measured whole. Repeated rows and rows without an id are
    judged by their text alone. An empty table gives no rows.
    """
    return docs.where(fertility.keeps()(F.col("text")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, all columns; see minhash.without_near_duplicates for repeated ids and ties.

    Rows without an id and texts without words are in no group and stay. Other columns may have any names. An empty table gives no
    rows.
    """
    return minhash.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null and empty texts are the end id alone.

    Repeated rows and rows without an id are packed each. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_classified),
    ("quality_rules", keep_by_rules),
    ("near_duplicates", keep_one_of_each_group),
    ("packing", pack),
]

#: The stages are models, signatures and a packing heuristic, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
