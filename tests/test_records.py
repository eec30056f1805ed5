"""Keyed records, evaluation by blocks of dates, prefixes of ensembles, and holdings carried by a stream."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import boosting as T
from quantloom.operators import validation as V
from quantloom.sources.records import Records
from quantloom.streaming.holdings import CURVES, holding_curves


def rows(spark, *values):
    return spark.createDataFrame(values, "name string, k int, x double")


def held(records):
    return sorted(map(tuple, records.read().select("name", "k", "x").collect()), key=str)


def test_two_writes_of_a_key_leave_one_row(spark, tmp_path):
    records = Records(spark, str(tmp_path), ("name", "k"), 4)
    with pytest.raises(FileNotFoundError):
        records.read()
    records.upsert(rows(spark, ("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 3.0), ("c", None, 4.0)))
    records.upsert(rows(spark, ("a", 1, 9.0), (None, 1, 8.0), ("d", 1, 5.0)))
    want = sorted([("a", 1, 9.0), ("b", 1, 2.0), (None, 1, 8.0), ("c", None, 4.0), ("d", 1, 5.0)], key=str)
    assert held(records) == want
    records.upsert(rows(spark).limit(0))
    assert held(records) == want
    for _ in range(3):
        records.upsert(rows(spark, ("a", 1, 9.0)))
    records.vacuum()
    assert held(records) == want
    assert len(list((tmp_path / "data").iterdir())) <= 4 + 2  # a folder for each bucket, and the version before


def test_only_touched_buckets_are_written(spark, tmp_path):
    records = Records(spark, str(tmp_path), ("k",), 8)
    records.upsert(spark.range(200).selectExpr("cast(id as int) k", "id * 1d x"))
    before = records._listing()[1]
    records.upsert(spark.range(5, 6).selectExpr("cast(id as int) k", "-1d x", "'new' more"))
    after = records._listing()[1]
    assert sum(before[b] != after[b] for b in before) == 1
    got = records.read()
    assert got.count() == 200 and [(r.x, r.more) for r in got.where("k = 5").collect()] == [(-1.0, "new")]


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    records = Records(spark, str(tmp_path), ("name", "k"), 4)
    records.upsert(rows(spark, ("a", 1, 1.0)))
    with monkeypatch.context() as m:
        m.setattr(Records, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            records.upsert(rows(spark, ("a", 1, 7.0)))
    assert held(records) == [("a", 1, 1.0)]
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            records.upsert(rows(spark, ("a", 1, 7.0)))
    assert held(records) == [("a", 1, 1.0)]
    assert records._files.createNewFile(records._path("versions", "2.taken"))  # another one writes this version
    with pytest.raises(RuntimeError):
        records.upsert(rows(spark, ("a", 1, 7.0)))
    assert held(records) == [("a", 1, 1.0)]


def test_repeated_keys(spark, tmp_path):
    records, twice = Records(spark, str(tmp_path), ("name", "k"), 4), rows(spark, ("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, None))
    with pytest.raises(Exception, match="a key comes more than once"):
        records.upsert(twice)
    records.upsert(twice, latest="x")
    assert held(records) == [("a", 1, 2.0), ("b", 1, None)]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    x = [(f"t{i % 30:02d}", i // 30, float(a), float(b), float(a - b / 2 + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    data = spark.createDataFrame(x, "ticker string, date_idx int, a double, b double, y double").withColumn("trade_date", F.expr("date_add(date'2020-01-01', date_idx)"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).cache()


def test_folds_are_blocks_of_dates(samples):
    got = V.in_blocks(samples, 3).select("date_idx", "fold").distinct().collect()
    assert sorted((r.date_idx, r.fold) for r in got) == [(i, i * 3 // 20) for i in range(20)]


def test_cross_validation_keeps_the_best_cell(samples):
    model = LinearRegression(labelCol="y", standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 50.0]).addGrid(model.elasticNetParam, [1.0]).build()
    fitted = V.cross_validated(samples, model, grid, 3)
    got = {(r.fold, r.cell): r.ic for r in V.cells(fitted, samples, 3).collect()}
    assert set(got) == {*itertools.product(range(3), range(2))}
    assert fitted.avgMetrics[0] == pytest.approx(np.mean([got[k, 0] for k in range(3)])) and fitted.avgMetrics[0] > 0.5
    assert all(got[k, 1] is None for k in range(3)) and fitted.avgMetrics[1] == 0.0  # such a penalty leaves a constant
    assert fitted.bestModel.getOrDefault("regParam") == 0.0


def test_prefixes_equal_brute_force(samples):
    train, valid = samples.where("date_idx < 14"), samples.where("date_idx >= 14")
    setting = T.Boosting(trees=8, depth=3, step=0.3, least=5, head=7, patience=0)
    model, best, scores = T.early_stopped(train, valid, setting)
    data, want = valid.collect(), []
    for n in range(1, 9):
        total = []
        for day in sorted({r.trade_date for r in data}):
            at = [(sum(w * t.predict(r.features) for t, w in zip(model.trees[:n], model.treeWeights[:n], strict=True)), r) for r in data if r.trade_date == day]
            total.append(np.mean([r.y for _, r in sorted(at, key=lambda x: (-x[0], x[1].ticker))[:7]]))
        want.append((n, float(np.mean(total))))
    assert [n for n, _ in scores] == [n for n, _ in want]
    assert [s for _, s in scores] == pytest.approx([s for _, s in want])
    assert best == max(want, key=lambda x: (round(x[1], 12), -x[0]))[0]
    whole = {(r.ticker, r.date_idx): r.prediction for r in model.transform(valid).collect()}
    assert {(r.ticker, r.date_idx): r.prediction for r in T.predicted(model, valid, 8).collect()} == pytest.approx(whole)


def test_prefixes_move_the_highest_only(spark, samples):
    """Before the exchange a partition keeps each prefix's and date's highest names, across batches and with equal predictions."""
    from collections import Counter

    train, valid = samples.where("date_idx < 14"), samples.where("date_idx >= 14")
    model = T.Boosting(trees=3, depth=1, step=0.3, least=5).fit(train)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scores = {r.prefix: r.score for r in T.prefix_scores(model, valid.coalesce(1), 4).collect()}
        plan = T.prefix_scores(model, valid, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    rows = valid.collect()
    assert max(Counter(model.predict(r.features) for r in rows).values()) > 4  # ties
    for n in (1, 2, 3):
        means = []
        for day in {r.date_idx for r in rows}:
            at = sorted((-sum(w * t.predict(r.features) for t, w in zip(model.trees[:n], model.treeWeights[:n], strict=True)), r.ticker, r.y) for r in rows if r.date_idx == day)[:4]
            means.append(np.mean([y for *_, y in at]))
        assert scores[n] == pytest.approx(np.mean(means))
    assert "Generate" not in plan  # no row for each name and prefix


def test_patience():
    scores = [(1, 1.0), (2, 3.0), (3, 2.0), (4, 3.0), (5, 1.0), (6, 9.0)]
    assert T.chosen(scores) == 6 and T.chosen(scores, 2) == 2 and T.chosen(scores, 4) == 6 and T.chosen([]) == 0


def test_a_stream_of_weights_equals_the_batch_after_each_part(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = [(p, f"t{k}", d, float(rng.random() < 0.5) if d != 7 or p else 0.0, None if rng.random() < 0.2 else float(rng.normal() / 10)) for p in range(3) for d in range(16) for k in range(6)]
    whole = spark.createDataFrame(x, "path_id int, ticker string, date_idx int, w double, ret double").withColumn("trade_date", F.expr("date_add(date'2020-01-01', date_idx)")).cache()
    rate, root = 0.01, str(tmp_path)
    flat = lambda df: sorted(tuple(None if v is None else v if not isinstance(v, float) else round(v, 9) for v in r) for r in df.collect())
    seen = 0
    for end in (4, 5, 11, 16):
        part = whole.where((F.col("date_idx") >= seen) & (F.col("date_idx") < end))
        if end == 11:  # dates that are past come again
            part = part.unionByName(whole.where("date_idx = 2"))
        part.drop("date_idx").write.mode("append").parquet(f"{root}/weights")
        seen = end
        stream = spark.readStream.schema(whole.drop("date_idx").schema).parquet(f"{root}/weights")
        holding_curves(stream, rate).writeStream.format("parquet").option("checkpointLocation", f"{root}/at").outputMode("append").trigger(availableNow=True).start(f"{root}/curves").awaitTermination()
        got = spark.read.schema(CURVES).parquet(f"{root}/curves")
        batch = B.portfolio(whole.where(F.col("date_idx") < end), "w", "ret", rate)
        want = batch.select("path_id", "trade_date", "gross", "net", "cost")
        assert flat(got.select("path_id", "trade_date", "gross", "net", "cost")) == flat(want)
        sums = batch.groupBy("path_id").agg(F.sum("net").alias("n"), F.sum("cost").alias("c"))
        assert flat(got.groupBy("path_id").agg(F.max_by("cum_net", "trade_date"), F.max_by("cum_cost", "trade_date"))) == flat(sums)
