"""A corpus, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns what it keeps with
the columns of documents; the last returns where each piece of each document lies.

Defined results: nulls, repeated ids and rows, empty and very long texts and extra columns are as each operator says
(a row without doc_id is judged by its text and never linked as a near duplicate); an empty table gives no rows. A stage's
intermediate tables go once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from tidelog.llm.common import stored, table
from tidelog.plans.scratch import scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return near_dedup.drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document finds its place in bins of one training sequence each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the near duplicates, the SimHash search or the packing; see tests/llm.
ORACLE_SQL = None
