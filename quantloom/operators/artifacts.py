"""Walk-forward models that are kept: one saved pipeline a window, coefficients, predictions as a feature.

A window's cleaning and its model are one pipeline model, so what reads it later cleans new rows by
the bounds of its training rows and learns nothing. Training can be taken up again after a failure:
windows whose model was saved whole are not fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..sources.store import Store
from .cleaning import chain
from .ml import learner

Window = tuple[int, int, int, int, int]
COEFFICIENTS = StructType([StructField("window_id", IntegerType()), StructField("feature", StringType()), StructField("coefficient", DoubleType())])


@dataclass(frozen=True)
class Trained:
    """The models of one name under a folder. ``kind``: a name of ``ml.learner``."""

    spark: SparkSession
    root: str
    name: str
    kind: str
    features: tuple[str, ...]

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def at(self, window: int) -> str:
        return f"{self.root.rstrip('/')}/models/{self.name}/{window}"

    def saved(self, window: int) -> bool:
        """Whether a window's model is there: its stages are written first, this mark last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at(window)}-whole")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self, data: DataFrame, lo: int, hi: int, trains: bool) -> DataFrame:
        return data.where(F.col("date_idx").between(lo, hi)).withColumn("is_train", F.lit(trains))

    def fit(self, data: DataFrame, window: Window, **options) -> PipelineModel:
        """Cleaning and model of one window's training dates."""
        _, lo, hi, _, _ = window
        train = self.rows(data, lo, hi, True)
        clean = chain(list(self.features), **options).fit(train)
        assembled = VectorAssembler(inputCols=list(self.features), outputCol="features")
        model = learner(self.kind)
        if self.kind == "logistic":
            model.setLabelCol("y")
        return PipelineModel([*clean.stages, assembled, model.fit(assembled.transform(clean.transform(train)))])

    def train(self, data: DataFrame, windows: list[Window], **options) -> None:
        """Fit and save the windows that aren't there yet; then write all coefficients and predictions anew.

        data: ticker, trade_date, date_idx, the features and y. ``options``: of ``cleaning.chain``.
        """
        new = [w for w in windows if not self.saved(w[0])]
        models = {}
        for w in new:
            models[w[0]] = self.fit(data, w, **options)
            models[w[0]].write().overwrite().save(self.at(w[0]))
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.at(w[0])}-whole")
        if new:
            models |= {k: self.load(k) for k, *_ in windows if k not in models}
            self.store.write("coefficient", self.coefficients(windows, models), name=self.name)
            self.store.write("feature", self.predict(data, windows, models=models), kind="ml_factors", name=self.name)

    def load(self, window: int) -> PipelineModel:
        return PipelineModel.load(self.at(window))

    def coefficients(self, windows: list[Window], models: dict[int, PipelineModel] | None = None) -> DataFrame:
        """window_id, feature, coefficient, as the saved models have them: a linear model's with its intercept, or a tree model's importances."""
        rows = []
        for k, *_ in windows:
            model = (models[k] if models else self.load(k)).stages[-1]
            linear = hasattr(model, "coefficients")
            values = (model.coefficients if linear else model.featureImportances).toArray()
            rows += [(k, f, float(v)) for f, v in zip(self.features, values, strict=True)] + ([(k, "(intercept)", float(model.intercept))] if linear else [])
        return self.spark.createDataFrame(rows, COEFFICIENTS)  # a row for each window and feature

    def predict(self, data: DataFrame, windows: list[Window], labels: bool = False, models: dict[int, PipelineModel] | None = None) -> DataFrame:
        """window_id, ticker, trade_date, value, with ``labels`` also y after cleaning: what the saved models say of the test dates. Nothing is fitted."""
        out = None
        for k, _, _, lo, hi in windows:
            got = (models[k] if models else self.load(k)).transform(self.rows(data, lo, hi, False))
            value = vector_to_array("probability")[1] if "probability" in got.columns else F.col("prediction")
            got = got.select(F.lit(k).alias("window_id"), "ticker", "trade_date", value.alias("value"), *(["y"] if labels else []))
            out = got if out is None else out.unionByName(got)
        if out is None:
            raise ValueError("no window to predict")
        return out

    def feature(self) -> DataFrame:
        """The predictions that were written, read as a feature."""
        return self.store.read("feature", kind="ml_factors", name=self.name)
