"""From raw documents to packed training sequences, one operator per stage.

Every stage takes the documents that its predecessor kept and, but for the last, returns
documents with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bagminhash, decontaminate, linejoin, packing, quality
from tidemark.llm.queries import VOCABULARY, table
from tidemark.workspace import free, materialize, scratch_scope


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line."""
    return linejoin.without_repeated_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences."""
    return packing.pack(docs, VOCABULARY)


_LEFT: dict[str, list[str]] = {}  # scratch folders of the stages run so far, by application


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a scratch folder of its own; those of earlier stages go, as their results are written and reread by now."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        while left:
            free(spark, left.pop())
        with scratch_scope(spark, stage.__name__) as folder:
            out = stage(spark, docs, sf_dir)
        left.append(folder)
        return out

    return run_stage


STAGES = [
    ("quality classifier", _tidy(quality_classifier)),
    ("line dedup", _tidy(line_dedup)),
    ("minhash near-dedup", _tidy(minhash_near_dedup)),
    ("benchmark decontamination", _tidy(benchmark_decontamination)),
    ("best-fit packing", _tidy(best_fit_packing)),
]

#: Fitted models and a tokenizer decide, which SQL cannot state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
