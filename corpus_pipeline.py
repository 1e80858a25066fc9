"""A training-data pipeline over ``documents``: drop low quality, keep one document of each
near-duplicate class, mask personal data, mix the sources to their weights, pack sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last keep the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from skewline.llm import mixing, ngramjoin, packing, pii, quality
from skewline.llm.common import Scratch, table
from skewline.session import apply_engine_conf


def stage(fn):
    """A stage sets up the session it is given, so that it can also run alone."""
    @functools.wraps(fn)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_engine_conf(spark)
        return fn(spark, docs, sf_dir)

    return run_alone


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return ngramjoin.keep_one(docs)


@stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.mask(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data),
          ("mix", mix), ("packing", pack)]

# A fitted classifier and a span model have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, apply in STAGES[:-1]:
        docs = scratch.store(apply(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
