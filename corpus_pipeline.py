"""A training corpus from raw documents: quality, near copies, secrets, mixture, packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder and
reads them again as the next stage's documents. All stages but the last return the columns of documents. Stages read whole
texts, take null texts for empty ones, keep or treat repeated rows as their docstrings say, give empty tables for empty
ones, and pass on columns of any other name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import jaccard, mixing, packing, ranking, secrets
from quillspark.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go; it is fitted on the labels of the table's own documents.

    Repeated rows and rows without an id are judged each by their text; equal texts stay or go together.
    """
    model = ranking.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ranking.keep(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; of rows of that id the one with the least text key,
    of repeated rows one; a group without any id keeps one row. All null and empty texts are one group."""
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all documents stay, repeated ones each; null texts stay null."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for; rows that tie in id and text are taken one by one, any of them first."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their text, length bucket, batch and slot; repeated rows are packed each."""
    return packing.pack(docs, with_text=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secret_scan), ("mixing", mixture), ("packing", packed)]
#: Ranking, banding and bucket optimisation can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
