"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

ONE_TASK_EDGES = 1_000_000  # 16 MB: up to here one task solves it, beyond it rounds of stars


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends of the edges, and the smallest id that each can reach."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for ends in (a, b, low[a], low[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each end to the smallest id that it reaches: as connected as the given edges, and fewer."""
    if not len(a):
        return a, b
    ids, low = roots(a, b)
    return ids[ids != low], low[ids != low]


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """id, component (the smallest id reached) of every end of ``edges`` (a, b)."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            e = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="i8"), *batches])
            ids, low = roots(e["a"].to_numpy("i8"), e["b"].to_numpy("i8"))
            yield pd.DataFrame({"id": ids, "component": low})

        return edges.repartition(1).mapInPandas(solve, "id long, component long")
    return stars(edges)


def stars(edges: DataFrame) -> DataFrame:
    """Large stars and small stars in turn until nothing changes; edges: distinct (a, b) with a > b."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        new = written(small, "small")
        dropped(edges, large)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = now
