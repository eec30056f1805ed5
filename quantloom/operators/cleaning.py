"""Cleaning of samples before a model, as stages of a pipeline that is saved with it.

Each row says in ``trainCol`` whether it may be learnt from. Bounds come from such rows only, and
what is meant for them alone (labels that go, extreme values that become null, rows that are dropped)
leaves other rows as they are. A fitted chain can be written, read and applied to later rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip

FLOAT, FLOATS, NAMES, TEXT, FLAG = TypeConverters.toFloat, TypeConverters.toListFloat, TypeConverters.toListString, TypeConverters.toString, TypeConverters.toBoolean


def param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters by keyword, readable as attributes; ``labelCol`` and ``trainCol`` of all stages."""

    labelCol = param("labelCol", "the label", TEXT)
    trainCol = param("trainCol", "whether a row may be learnt from", TEXT)
    defaults: dict = {}

    def __init__(self, **values):
        super().__init__()
        self._setDefault(labelCol="y", trainCol="is_train", **self.defaults)
        self._set(**values)

    def value(self, name: str):
        return self.getOrDefault(name)

    @property
    def label(self) -> Column:
        return F.col(self.value("labelCol"))

    @property
    def trains(self) -> Column:
        return F.coalesce(F.col(self.value("trainCol")), F.lit(False))

    def relabelled(self, data: DataFrame, keep: Column) -> DataFrame:
        """Null labels where ``keep`` doesn't hold."""
        return data.withColumn(self.value("labelCol"), F.when(keep, self.label))

    def shared(self) -> dict:
        return {n: self.value(n) for n in ("labelCol", "trainCol")}


def exact_percentiles(rows: DataFrame, names: list[str], at: list[float], accuracy: int = 10_000) -> list[list[float] | None]:
    """As ``percentile``, which holds every distinct value in one task: a first pass brackets each by approximate ones, a second counts what is below and sorts what is inside, some ten-thousandths of the rows."""
    wide = [min(1.0, max(0.0, q + d / accuracy)) for q in at for d in (-3, 3)]
    ends = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), wide, accuracy).alias(f"q{i}") for i, c in enumerate(names)]).first()
    aggs = []
    for i, c in enumerate(names):
        aggs.append(F.count(c).alias(f"n{i}"))
        for k in range(len(at)) if ends[i] is not None else ():
            low, high, x = F.lit(ends[i][2 * k]), F.lit(ends[i][2 * k + 1]), F.col(c).cast("double")
            aggs += [F.count(F.when(x < low, 1)).alias(f"b{i}_{k}"), F.sort_array(F.collect_list(F.when((x >= low) & (x <= high), x))).alias(f"v{i}_{k}")]
    inside = rows.agg(*aggs)
    asked = []
    for i in range(len(names)):
        for k, q in enumerate(at) if ends[i] is not None else ():
            place = (F.col(f"n{i}") - 1) * F.lit(q)
            asked += [place.alias(f"p{i}_{k}"), *[F.get(f"v{i}_{k}", (f(place) - F.col(f"b{i}_{k}")).cast("int")).alias(f"{e}{i}_{k}") for e, f in (("lo", F.floor), ("hi", F.ceil))]]
    found = inside.select(F.lit(0), *asked).first()
    out: list[list[float] | None] = []
    for i, c in enumerate(names):
        if ends[i] is None:
            out.append(None)
            continue
        got = []
        for k, q in enumerate(at):
            place, low, high = found[f"p{i}_{k}"], found[f"lo{i}_{k}"], found[f"hi{i}_{k}"]
            if low is None or high is None:  # outside the bracket
                got.append(rows.agg(F.percentile(c, q)).first()[0])
            else:
                got.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
        out.append(got)
    return out


class FuzzyLabel(Stage, Estimator):
    """Takes labels away that say little: those near 0, then those far from the mean of the others."""

    threshold = param("threshold", "labels nearer to 0 go", FLOAT)
    rate = param("rate", "labels farther from the mean than so many standard deviations go", FLOAT)
    defaults = {"threshold": 0.01, "rate": 1.5}

    def _fit(self, dataset: DataFrame) -> FuzzyLabelModel:
        y = F.when(F.abs(self.label) >= self.value("threshold"), self.label)
        mean, std = dataset.where(self.trains).agg(F.avg(y), F.stddev(y)).first()
        wide = self.value("rate") * std if std is not None else float("inf")
        return FuzzyLabelModel(threshold=self.value("threshold"), lower=(mean or 0.0) - wide, upper=(mean or 0.0) + wide, **self.shared())


class FuzzyLabelModel(Stage, Model):
    threshold = FuzzyLabel.threshold
    lower = param("lower", "labels below go", FLOAT)
    upper = param("upper", "labels above go", FLOAT)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ok = (F.abs(self.label) >= self.value("threshold")) & self.label.between(self.value("lower"), self.value("upper"))
        return self.relabelled(dataset, ~self.trains | ok)


class ClassLabel(Stage, Transformer):
    """1 above 0, else 0; null stays null."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.value("labelCol"), (self.label > 0).cast("double"))


class Winsorize(Stage, Estimator):
    """Clips features at ``near`` ranges (90th less 10th percentile) from their median; training values beyond ``far`` ranges become null."""

    inputCols = param("inputCols", "the features", NAMES)
    near = param("near", "ranges to the bounds", FLOAT)
    far = param("far", "ranges beyond which training values are dropped", FLOAT)
    normalize = param("normalize", "whether medians are taken off and ranges divided by", FLAG)
    accuracy = param("accuracy", "0 for exact percentiles, else 1 / the relative error of approximate ones", TypeConverters.toInt)
    defaults = {"near": 2.5, "far": 4.0, "normalize": False, "accuracy": 0}

    def _fit(self, dataset: DataFrame) -> WinsorizeModel:
        at, names, n = [0.1, 0.5, 0.9], self.value("inputCols"), self.value("accuracy")
        rows = dataset.where(self.trains)
        found = rows.agg(*[F.percentile_approx(c, at, n).alias(f"q{i}") for i, c in enumerate(names)]).first() if n else exact_percentiles(rows, names, at)
        low, mid, high = zip(*[[float("nan")] * 3 if x is None else x for x in found], strict=True)
        return WinsorizeModel(inputCols=names, near=self.value("near"), far=self.value("far"), normalize=self.value("normalize"), medians=list(mid), ranges=[h - b for h, b in zip(high, low, strict=True)], **self.shared())


class WinsorizeModel(Stage, Model):
    inputCols, near, far, normalize = Winsorize.inputCols, Winsorize.near, Winsorize.far, Winsorize.normalize
    medians = param("medians", "medians of the training rows", FLOATS)
    ranges = param("ranges", "ranges of the training rows", FLOATS)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        near, far, done = self.value("near"), self.value("far"), {}
        for c, median, wide in zip(self.value("inputCols"), self.value("medians"), self.value("ranges"), strict=True):
            if median != median:  # no training row has a value
                continue
            x = clip(F.col(c), F.lit(median - near * wide), F.lit(median + near * wide))
            x = F.when(~self.trains | (F.abs(F.col(c) - median) <= far * wide), x)
            done[c] = (x - median) / (wide + 1e-7) if self.value("normalize") else x
        return dataset.withColumns(done)


class SparseRows(Stage, Transformer):
    """Takes the label of rows that lack more than a share of their features."""

    inputCols = Winsorize.inputCols
    share = param("share", "of the features that may be missing", FLOAT)
    defaults = {"share": 0.3}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.value("inputCols")
        lacking = reduce(Column.__add__, [F.col(c).isNull().cast("int") for c in names])
        return self.relabelled(dataset, lacking <= self.value("share") * len(names))


class Fill(Stage, Transformer):
    """Missing features as 0, or left alone."""

    inputCols = Winsorize.inputCols
    method = param("method", "fill0 or ignore", TEXT)
    defaults = {"method": "fill0"}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.value("method") not in ("fill0", "ignore"):
            raise ValueError(f"unknown method {self.value('method')}; known: fill0, ignore")
        return dataset.na.fill(0.0, self.value("inputCols")) if self.value("method") == "fill0" else dataset


class Labelled(Stage, Transformer):
    """Drops training rows without a label."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.where(~self.trains | self.label.isNotNull())


def chain(features: list[str], classes: bool = False, fuzzy: tuple[float, float] | None = (0.01, 1.5), normalize: bool = False, fill: str = "fill0") -> Pipeline:
    """The stages in their order: fuzzy labels, classes, winsorized features, sparse rows, filled features, rows without a label."""
    stages: list = [FuzzyLabel(threshold=fuzzy[0], rate=fuzzy[1])] if fuzzy else []
    stages += [ClassLabel()] if classes else []
    return Pipeline(stages=[*stages, Winsorize(inputCols=features, normalize=normalize), SparseRows(inputCols=features), Fill(inputCols=features, method=fill), Labelled()])
