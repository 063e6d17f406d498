"""Corpus pipeline: toxicity, exact dedup, near dedup, decontamination, mixing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the
last return the columns of ``documents``.  The mix adds ``copy_no`` and has a document as
many times as it is taken.  A stage reads ``labels`` or ``benchmark`` from ``sf_dir``.

Defined cases are those of the operators; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm.common import cut, table
from textmill.llm.decontamination import decontaminated
from textmill.llm.exact_dedup import exact_dedup
from textmill.llm.mixing import mixed
from textmill.llm.ngram_join import without_near_copies
from textmill.llm.toxicity import rejecting


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return rejecting(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays."""
    return without_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights."""
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram join", near),
    ("decontamination", clean),
    ("mixing", mix),
]
ORACLE_SQL = None  # SQL can't express the model and the draws; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
