"""Cleaning chains and kept models: bounds from training rows only, nothing fitted when models are read."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from quantloom.operators import cleaning
from quantloom.operators.artifacts import Trained

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = [float(v) if rng.random() > 0.15 else None for v in rng.normal(size=4) * [1, 5, 0.1, 3]]
        y = float(sum(v or 0 for v in x) + rng.normal())
        rows.append((f"{i % 20:06d}", i // 20, *x, y if i % 17 else None, i // 20 < 12))
    return spark.createDataFrame(rows, "ticker string, date_idx int, a double, b double, c double, d double, y double, is_train boolean").withColumn("trade_date", F.expr("date_add(date'2020-01-01', date_idx)")).cache()


def brute(rows, normalize=False):
    train = [r for r in rows if r.is_train]
    near = np.array([r.y for r in train if r.y is not None and abs(r.y) >= 0.5])
    mean, std = near.mean(), near.std(ddof=1)
    out = []
    for r in rows:
        y = r.y
        if r.is_train and (y is None or abs(y) < 0.5 or abs(y - mean) > 2 * std):
            y = None
        xs = []
        for c in NAMES:
            lo, mid, hi = np.quantile([t[c] for t in train if t[c] is not None], [0.1, 0.5, 0.9])
            x, wide = r[c], hi - lo
            if x is not None and r.is_train and abs(x - mid) > 4 * wide:
                x = None
            if x is not None:
                x = min(max(x, mid - 2.5 * wide), mid + 2.5 * wide)
                x = (x - mid) / (wide + 1e-7) if normalize else x
            xs.append(x)
        if sum(x is None for x in xs) > 0.3 * 4:
            y = None
        if not r.is_train or y is not None:
            out.append((r.ticker, r.date_idx, *[0.0 if x is None else x for x in xs], y))
    return out


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a[2:], b[2:], strict=True))


def cleaned(model, rows):
    return [tuple(r) for r in model.transform(rows).select("ticker", "date_idx", *NAMES, "y").collect()]


@pytest.mark.parametrize("normalize", [False, True])
def test_chain_equals_plain_cleaning_also_when_read_back(data, tmp_path, normalize):
    chain = cleaning.chain(NAMES, fuzzy=(0.5, 2.0), normalize=normalize)
    model = chain.fit(data)
    want = brute(data.collect(), normalize)
    same(cleaned(model, data), want)
    model.write().overwrite().save(str(tmp_path / "model"))
    same(cleaned(PipelineModel.load(str(tmp_path / "model")), data), want)
    chain.write().overwrite().save(str(tmp_path / "chain"))
    same(cleaned(Pipeline.load(str(tmp_path / "chain")).fit(data), data), want)


def test_test_rows_dont_move_the_bounds(data):
    wild = data.withColumns({c: F.when(F.col("is_train"), F.col(c)).otherwise(F.lit(1e6)) for c in (*NAMES, "y")})
    a, b = (cleaning.chain(NAMES).fit(x) for x in (data, wild))
    for one, other in zip(a.stages, b.stages, strict=True):
        params = lambda s: {p.name: s.getOrDefault(p) for p in s.params}
        assert params(one) == params(other)


def test_classes_empty_tables_and_features_without_values(spark, data):
    none = data.withColumn("a", F.lit(None).cast("double"))
    got = cleaning.chain(NAMES, classes=True, fuzzy=None, fill="ignore").fit(none).transform(none)
    assert {r.y for r in got.collect()} <= {0.0, 1.0, None} and got.where("a is not null").count() == 0
    assert cleaning.chain(NAMES).fit(data.limit(0)).transform(data.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cleaning.Fill(inputCols=NAMES, method="mean").transform(data)


WINDOWS = [(0, 0, 9, 11, 13), (1, 3, 12, 14, 16)]


def test_kept_models_predict_without_fitting(spark, data, tmp_path, monkeypatch):
    kept = Trained(spark, str(tmp_path), "lr", "linear", tuple(NAMES))
    samples = data.drop("is_train")
    fitted = {k: kept.fit(samples, w).transform(kept.rows(samples, w[3], w[4], False)) for k, w in enumerate(WINDOWS)}
    want = sorted((k, r.ticker, r.trade_date, round(r.prediction, 9)) for k, df in fitted.items() for r in df.collect())
    fit, calls = LinearRegression.fit, []

    def failing(self, *args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return fit(self, *args)

    monkeypatch.setattr(LinearRegression, "fit", failing)
    with pytest.raises(RuntimeError):
        kept.train(samples, WINDOWS)
    kept.train(samples, WINDOWS)  # the first window isn't fitted again
    assert len(calls) == 3
    monkeypatch.setattr(LinearRegression, "fit", lambda *a: pytest.fail("fitted"))
    kept.train(samples, WINDOWS)
    for got in (kept.predict(samples, WINDOWS), kept.feature()):
        assert sorted((r.window_id, r.ticker, r.trade_date, round(r.value, 9)) for r in got.collect()) == want
    rows = kept.store.read("coefficient", name="lr").collect()
    assert len(rows) == 2 * 5 and {r.feature for r in rows} == {*NAMES, "(intercept)"}
