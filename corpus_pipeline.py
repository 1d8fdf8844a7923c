"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go, then those that the quality rules reject; one document of each near-duplicate group stays, contaminated
documents go, and what is left is packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bin_search, decontaminate, ngram_join, quality, toxicity
from quarry.llm.common import batches_of, scratch, shared_folder, table, written

#: Whole texts that go to Python at once, if they have no more than BATCH_BYTES together.
BATCH_ROWS = 500


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with its rows computed and written before it returns: whoever reads them later has other bounds for batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with batches_of(spark, BATCH_ROWS):
            return written(stage(spark, docs, sf_dir), "stage")

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_content(docs, table(spark, sf_dir, "labels"))


@bounded
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_search.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifiers' verdicts can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
