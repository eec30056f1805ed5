"""Sample assembly and walk-forward models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, corr, div, lag, rank_avg, with_date


PART_ROWS = 200_000  # rows of a task of a fit
AT_ONCE = 4  # windows


def samples(panel: DataFrame, features: list[str], lags: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """ticker, trade_date, features with their lags, and y: the forward return less its date's mean; and the columns ``keep``. Rows stay where the panel has them."""
    cols = {f"{f}_{k}": lag(f, k) for f in features for k in range(lags)}
    p = panel.withColumns(cols).withColumn("y0", div(lag("vwap", -2), lag("vwap", -1)) - 1).select("ticker", "trade_date", "date_idx", *cols, "y0", *keep)
    return with_date(p, mean=F.avg("y0")).select("ticker", "trade_date", "date_idx", *cols, (F.col("y0") - F.col("mean")).alias("y"), *keep), list(cols)


def winsorize_features(panel: DataFrame, features: list[str], train_end: int) -> DataFrame:
    """Adds f_w: beyond median +- 4 ranges (q90 - q10) null, beyond 2.5 clipped; later dates are clipped by the same bounds."""
    train = F.col("date_idx") < train_end
    stats = panel.where(train).agg(*[F.percentile(f, [0.5, 0.1, 0.9]).alias(f"q_{f}") for f in features])
    p = panel.crossJoin(F.broadcast(stats))  # one row
    for f in features:
        med, wide = F.col(f"q_{f}")[0], F.col(f"q_{f}")[2] - F.col(f"q_{f}")[1]
        cut = clip(F.col(f), med - 2.5 * wide, med + 2.5 * wide)
        p = p.withColumn(f"{f}_w", F.when(~train | (F.abs(F.col(f) - med) <= 4 * wide), cut)).drop(f"q_{f}")
    return p


def learner(kind: str, seed: int = 1):
    """A regressor by name. Trees stand in for boosting libraries that aren't there."""
    return {
        "linear": lambda: LinearRegression(labelCol="y", standardization=False),
        "ridge": lambda: LinearRegression(labelCol="y", regParam=0.01, elasticNetParam=0.0, standardization=False),
        "lasso": lambda: LinearRegression(labelCol="y", regParam=0.001, elasticNetParam=1.0, standardization=False),
        "logistic": lambda: LogisticRegression(labelCol="up", regParam=0.01, standardization=False),
        "gbt": lambda: GBTRegressor(labelCol="y", maxIter=40, maxDepth=5, stepSize=0.1, minInstancesPerNode=25, seed=seed),
        "forest": lambda: RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=4, seed=seed),
    }[kind]()


def gathered(data: DataFrame, rows: int) -> DataFrame:
    """``data`` in as few partitions as its rows and the cores ask for: a tree takes a pass over the rows for each level, which otherwise is mostly the start of tasks. Rows don't move."""
    return data.coalesce(max(data.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def by_window(fit: Callable, windows: list) -> list:
    """``fit`` of each window, some at once: a fit's jobs are many and short, so one alone leaves cores free."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(fit), windows))


def prepared(panel: DataFrame, features: list[str], scale: float = 100.0, weight: str | None = None) -> tuple[DataFrame, list[str]]:
    """Samples with assembled features, missing ones as 0; ``up`` is 1 where the label is above 0; ``weight`` is a column of the panel, missing or negative ones as 0."""
    if weight:
        panel = panel.withColumn("weight", F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)))
    data, names = samples(panel, features, keep=("weight",) if weight else ())
    data = data.na.fill(0.0, names).withColumn("y", F.col("y") * scale).withColumn("up", (F.col("y") > 0).cast("double"))
    return gathered(VectorAssembler(inputCols=names, outputCol="features").transform(data), panel.count()).cache(), names


def fitted(data: DataFrame, kind: str, lo: int, hi: int, weighted: bool = False):
    model = learner(kind)
    if weighted:
        model.setWeightCol("weight")
    return model.fit(data.where(F.col("date_idx").between(lo, hi) & F.col("y").isNotNull()))


def walk_forward(panel: DataFrame, features: list[str], kind: str, windows: list[tuple[int, int, int, int, int]], scale: float = 100.0, weight: str | None = None) -> DataFrame:
    """Predictions of each window's test dates, by a model fitted on its training dates; a logistic model predicts the chance of a label above 0."""
    data, _ = prepared(panel, features, scale, weight)
    out = None
    models = by_window(lambda w: fitted(data, kind, w[1], w[2], bool(weight)), windows)
    for model, (k, _, _, test_lo, test_hi) in zip(models, windows, strict=True):
        got = model.transform(data.where(F.col("date_idx").between(test_lo, test_hi)))
        prediction = vector_to_array("probability")[1] if kind == "logistic" else F.col("prediction")
        got = got.select(F.lit(k).alias("window_id"), "ticker", "trade_date", "date_idx", prediction.alias("prediction"), "y")
        out = got if out is None else out.unionByName(got)
    return out


def importances(panel: DataFrame, features: list[str], kind: str, windows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(window_id, feature, importance): a tree model's importances, or a linear one's coefficients."""
    data, names = prepared(panel, features)
    rows = []
    for model, (k, *_) in zip(by_window(lambda w: fitted(data, kind, w[1], w[2]), windows), windows, strict=True):
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
        rows += [(k, n, float(v)) for n, v in zip(names, values.toArray(), strict=True)]  # a row for each window and feature
    return panel.sparkSession.createDataFrame(rows, "window_id int, feature string, importance double")


def metrics(pred: DataFrame, p: str = "prediction", y: str = "y") -> DataFrame:
    """R2, RMSE, correlation, mean correlation per date, slope and the mean label of the top decile per window."""
    both = pred.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    per_date = both.groupBy("window_id", "trade_date").agg(corr(p, y).alias("c")).groupBy("window_id").agg(F.avg("c").alias("ic_cs"))
    ranked = both.withColumn("share", rank_avg(p, by="window_id") / F.count("*").over(_window("window_id")))
    err = F.col(y) - F.col(p)
    main = ranked.groupBy("window_id").agg(
        F.count("*").alias("n"), (1 - div(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"), corr(p, y).alias("ic"),
        div(F.covar_samp(F.col(y), F.col(p)), F.var_pop(y)).alias("slope"), F.avg(F.when(F.col("share") > 0.9, F.col(y))).alias("top_decile"),
    )
    return main.join(per_date, "window_id")


def full_metrics(pred: DataFrame, features: int) -> DataFrame:
    """window_id, n, R2 and R2 adjusted for ``features``, RMSE, correlations (of values, with ranks of the label, and their means per date), slope, the top decile's mean label; and accuracy, precision, recall and F1 of the signs."""
    both = pred.where("prediction is not null and y is not null")
    w = _window("window_id")
    per_date = both.withColumn("rk", rank_avg("y", by=["window_id", "trade_date"])).groupBy("window_id", "trade_date").agg(corr("prediction", "y").alias("a"), corr("prediction", "rk").alias("b")).groupBy("window_id").agg(F.avg("a").alias("ic_cs"), F.avg("b").alias("sm_ic_cs"))
    p, y = F.col("prediction"), F.col("y")
    hit, said, true = ((p > 0) & (y > 0)).cast("double"), (p > 0).cast("double"), (y > 0).cast("double")
    ranked = both.withColumns({"rk": F.row_number().over(w.orderBy("y", "trade_date", "ticker")), "share": rank_avg("prediction", by="window_id") / F.count("*").over(w)})
    m = ranked.groupBy("window_id").agg(
        F.count("*").alias("n"), (1 - div(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), corr("prediction", "y").alias("ic"), corr("prediction", "rk").alias("sm_ic"),
        div(F.covar_samp(p, y), F.var_pop(y)).alias("slope"), F.avg(F.when(F.col("share") > 0.9, y)).alias("top_decile"),
        F.avg((said == true).cast("double")).alias("accuracy"), div(F.sum(hit), F.sum(said)).alias("precision"), div(F.sum(hit), F.sum(true)).alias("recall"),
    )
    m = m.withColumns({"adj_r2": 1 - (1 - F.col("r2")) * div(F.col("n") - 1, F.col("n") - features - 1), "f1": div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))})
    return m.join(per_date, "window_id")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


MODELS: dict[str, Callable[..., DataFrame]] = {k: (lambda panel, features, windows, kind=k: walk_forward(panel, features, kind, windows)) for k in ("linear", "ridge", "lasso", "logistic", "gbt", "forest")}
