"""From raw documents to a training set: classify, remove near duplicates and test questions, mix, shard.

Every stage takes and returns documents; its result is written before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsgauge.llm.decontamination import without_contaminated
from opsgauge.llm.mixing import repeated
from opsgauge.llm.near_duplicates import one_of_each
from opsgauge.llm.quality_classifier import keep_best
from opsgauge.llm.sharding import sharded
from opsgauge.llm.shared import drop_written, written_paths
from opsgauge.session import working_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_left: list[str] = []


def _stage(function: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # The results of earlier stages are stored by now: what they were made of can go.
        drop_written(spark, _left, reader=docs)
        before = set(written_paths())
        result = function(spark, docs, sf_dir)
        _left[:] = [path for path in [*_left, *written_paths()] if path not in before]
        return result

    return run_stage


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return keep_best(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for."""
    return repeated(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it, uniformly shuffled."""
    return sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# Weights from counts of hashed n-grams and random draws are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = working_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
