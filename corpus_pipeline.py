"""From raw documents to packed sequences: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's documents. The first three return the documents that they keep, with all
their columns; the last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import jaccard, packing, quality, toxicity
from quantloom.llm.common import documents, dropped, fresh, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    (score,) = fresh(docs, "score")
    labels = quality.training_labels(spark, sf_dir, "quality", quality.FOLDS, quality.HELD_OUT)
    return quality.quality(docs, labels, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic."""
    (score,) = fresh(docs, "score")
    labels = quality.training_labels(spark, sf_dir, "toxic", toxicity.FOLDS, toxicity.HELD_OUT)
    return toxicity.toxicity(docs, labels, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingle sets are similar."""
    return jaccard.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("duplicates", duplicates_stage), ("packing", packing_stage)]

#: Trained scores and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # it has read all documents
    dropped(docs)
    return out
