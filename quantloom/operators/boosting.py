"""Boosted trees with an evaluation of their own: every prefix of the ensemble is scored in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosting:
    """Settings: trees at most, and the trees after the best prefix at which the search ends (0: never)."""

    trees: int = 100
    depth: int = 8
    step: float = 0.05
    least: int = 25
    head: int = 100
    patience: int = 20
    seed: int = 1

    def fit(self, train: DataFrame) -> GBTRegressionModel:
        return GBTRegressor(labelCol="y", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, minInstancesPerNode=self.least, seed=self.seed).fit(train)


def with_trees(model: GBTRegressionModel, data: DataFrame) -> tuple[DataFrame, Column]:
    """``data`` with each tree's prediction, and the array of their parts of the ensemble's."""
    for i, tree in enumerate(model.trees):
        tree.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(f"tree_{i}")
        data = tree.transform(data)
    return data, F.array(*[F.col(f"tree_{i}") * w for i, w in enumerate(model.treeWeights)])


def highest(day: np.ndarray, prediction: np.ndarray, named: np.ndarray, ticker: np.ndarray, head: int) -> np.ndarray:
    """Rows of each day's ``head`` highest predictions, ties by ticker."""
    order = np.lexsort((ticker, named, -prediction, day))
    first = np.flatnonzero(np.diff(day[order], prepend=day[order[0]] - 1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[nth < head]


def prefix_scores(model: GBTRegressionModel, data: DataFrame, head: int = 100) -> DataFrame:
    """prefix (trees, from 1), score: the mean over dates of the mean label of the ``head`` names that the first trees predict highest, ties by ticker.

    Each partition names its own highest for every prefix and date, so only these are moved and ranked, not every row for every prefix.
    """
    data, parts = with_trees(model, data.select("ticker", "trade_date", "features", "y").where("y is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list[np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            sums = np.cumsum(np.stack(list(b["parts"])).astype("f8"), axis=1)
            own = [b["day"].to_numpy("i8"), b["ticker"].notna().to_numpy(), b["ticker"].fillna("").to_numpy("U"), b["y"].to_numpy("f8")]
            for k in range(sums.shape[1]):
                day, named, ticker, y, prediction = rows = [*own, sums[:, k]]
                if k < len(kept):
                    day, named, ticker, y, prediction = rows = [np.concatenate(x) for x in zip(kept[k], rows, strict=True)]
                at = highest(day, prediction, named, ticker, head)
                kept[k : k + 1] = [[x[at] for x in rows]]
        for k, (day, named, ticker, y, prediction) in enumerate(kept):
            yield pd.DataFrame({"prefix": k, "day": day, "ticker": pd.Series(ticker.astype(object)).where(named, None), "y": y, "prediction": prediction})

    each = data.select("ticker", F.unix_date("trade_date").alias("day"), "y", parts.alias("parts")).mapInPandas(run, "prefix int, day int, ticker string, y double, prediction double")
    best = Window.partitionBy("prefix", "day").orderBy(F.desc("prediction"), "ticker")
    top = each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= head)
    per_date = top.groupBy("prefix", "day").agg(F.avg("y").alias("mean"))
    return per_date.groupBy((F.col("prefix") + 1).alias("prefix")).agg(F.avg("mean").alias("score"))


def chosen(scores: list[tuple[int, float]], patience: int = 0) -> int:
    """The prefix of the highest score, the shortest of equal ones; only what comes before ``patience`` trees in a row without a better one counts."""
    best, top = 0, float("-inf")
    for prefix, score in sorted(scores):
        if patience and best and prefix - best > patience:
            break
        if score > top:
            best, top = prefix, score
    return best


def predicted(model: GBTRegressionModel, data: DataFrame, prefix: int) -> DataFrame:
    """``data`` with prediction, by the first ``prefix`` trees."""
    columns = data.columns
    data, parts = with_trees(model, data)
    return data.select(*columns, F.aggregate(F.slice(parts, 1, prefix), F.lit(0.0), lambda a, x: a + x).alias("prediction"))


def early_stopped(train: DataFrame, valid: DataFrame, setting: Boosting = Boosting()) -> tuple[GBTRegressionModel, int, list[tuple[int, float]]]:
    """The model of ``train``, the number of trees that ``valid`` chooses, and the score of each number. Rows: ticker, trade_date, features, y."""
    model = setting.fit(train)
    scores = [(r.prefix, r.score) for r in prefix_scores(model, valid, setting.head).collect()]  # one for each tree
    return model, chosen(scores, setting.patience), sorted(scores)
