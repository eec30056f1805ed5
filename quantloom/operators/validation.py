"""Cross-validation by blocks of dates, judged by the information coefficient."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import corr


class InformationCoefficient(Evaluator, HasLabelCol, HasPredictionCol):
    """The mean over dates of the correlation of predictions and labels; more is better."""

    def __init__(self, labelCol: str = "y", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        per_date = dataset.groupBy("trade_date").agg(corr(self.getPredictionCol(), self.getLabelCol()).alias("ic"))
        return per_date.agg(F.coalesce(F.avg("ic"), F.lit(0.0))).first()[0]

    def isLargerBetter(self) -> bool:
        return True


def in_blocks(data: DataFrame, folds: int) -> DataFrame:
    """With fold, from 0: dates in order, cut into ``folds`` runs of near equal numbers of dates."""
    dates = data.select("trade_date").distinct()
    nth = F.row_number().over(Window.orderBy("trade_date")) - 1  # a row for each date
    dates = dates.withColumns({"nth": nth, "n": F.count("*").over(Window.partitionBy())})
    return data.join(F.broadcast(dates.select("trade_date", F.expr(f"int(nth * {folds} div n)").alias("fold"))), "trade_date")


def cross_validated(data: DataFrame, estimator, grid: list[dict], folds: int, evaluator: Evaluator | None = None) -> CrossValidatorModel:
    """The estimator with the best cell of ``grid`` (a list of parameter maps), fitted on all rows; each cell's model of each fold is kept."""
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator or InformationCoefficient(), numFolds=folds, foldCol="fold", collectSubModels=True)
    return cv.fit(in_blocks(data, folds))


def cells(fitted: CrossValidatorModel, data: DataFrame, folds: int) -> DataFrame:
    """fold, cell, ic, rmse: each fold's rows by the models that didn't see them."""
    data = in_blocks(data, folds)
    parts = [model.transform(data.where(F.col("fold") == k)).select(F.lit(k).alias("fold"), F.lit(i).alias("cell"), "trade_date", "prediction", "y") for k, models in enumerate(fitted.subModels) for i, model in enumerate(models)]
    per_date = reduce(DataFrame.unionByName, parts).groupBy("fold", "cell", "trade_date").agg(corr("prediction", "y").alias("ic"), F.sum(F.pow(F.col("prediction") - F.col("y"), F.lit(2))).alias("err"), F.count("y").alias("n"))
    return per_date.groupBy("fold", "cell").agg(F.avg("ic").alias("ic"), F.sqrt(F.sum("err") / F.sum("n")).alias("rmse"))
