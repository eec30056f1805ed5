"""Steps that leave the panel's rows where they are: nothing is dealt anew by date."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import factors as X
from quantloom.operators import masks as M
from quantloom.operators import ml as L
from quantloom.operators.cleaning import exact_percentiles


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{i:04d}", d, None if rng.random() < 0.1 else float(rng.integers(1, 9)), i % 3) for i in range(60) for d in range(12)]
    p = spark.createDataFrame(rows, "ticker string, date_idx int, v double, region int").withColumn("trade_date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("date_idx")))
    return p.select("*", *[F.col("v").alias(c) for c in ("ret", "turnover", "vwap", "cap", "value")]).repartition(6, "ticker").sortWithinPartitions("ticker", "date_idx").cache()


def dealt_by_date(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "trade_date" in x and not any(k in x for k in ("of_", "nth"))]


def test_samples(panel):
    """Labels without a window over all rows of a date, weights without a join."""
    data, names = L.prepared(panel, ["ret", "turnover"], weight="cap")
    assert "weight" in data.columns and "SortMergeJoin" not in data._jdf.queryExecution().executedPlan().toString()
    got = L.samples(panel, ["ret"])[0]
    assert "Window [avg" not in got._jdf.queryExecution().executedPlan().toString()
    assert abs(got.groupBy("trade_date").agg(F.avg("y").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-12


def test_ends_of_a_date(panel):
    """the same marks as by the rank of every name."""
    got = B.top_bottom(panel, "v", 7, 3)
    day = Window.partitionBy("trade_date")
    end = F.when(F.col("date_idx") < 11, F.col("v"))
    rk = F.row_number().over(day.orderBy(F.asc_nulls_last("f"), "ticker"))
    want = panel.withColumn("f", end).withColumns({"rk": rk, "n": F.count("f").over(day)})
    want = want.withColumns({"top": F.when(F.col("n") > 0, (F.col("f").isNotNull() & (F.col("rk") > F.col("n") - 7)).cast("double")), "low": F.when(F.col("n") > 0, (F.col("f").isNotNull() & (F.col("rk") <= 7)).cast("double"))})
    key = lambda r: (r.ticker, r.date_idx, r.top, r.low)
    assert sorted(map(repr, map(key, got.where("path_id = 0").collect()))) == sorted(map(repr, map(key, want.collect())))
    assert "Window [row_number() windowspecdefinition(trade_date" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "turnover" in x)


def test_class_and_weights(panel):
    """F29, F31."""
    for df in (X.merged(panel, ["ret", "turnover"]), M.index_weights(panel)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = M.index_weights(panel).groupBy("trade_date", "index_code").agg(F.sum("weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert abs(got[0] - 100) < 1e-9 and abs(got[1] - 100) < 1e-9


def test_exact_percentiles(spark):
    """no task holds all values."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 50_000):
        df = spark.createDataFrame([(float(a), float(b) if b > 0 else None) for a, b in zip(rng.normal(size=n), np.round(rng.normal(size=n), 1), strict=True)], "a double, b double")
        want = df.agg(F.percentile("a", [0.1, 0.5, 0.9]), F.percentile("b", [0.1, 0.5, 0.9])).first()
        got = exact_percentiles(df, ["a", "b"], [0.1, 0.5, 0.9])
        for w, g in zip(want, got, strict=True):
            assert (w is None and g is None) or np.allclose(w, g, rtol=0, atol=1e-15)


def test_fits_run_side_by_side_on_few_partitions(spark):
    """a fit's rows were in as many partitions as the panel, and windows waited for each other."""
    from threading import Barrier

    from quantloom.operators import ml

    cores = spark.sparkContext.defaultParallelism
    data = spark.range(1000).repartition(40)
    assert ml.gathered(data, 1000).rdd.getNumPartitions() == cores and ml.gathered(data, ml.PART_ROWS * 30).rdd.getNumPartitions() == 30
    together = Barrier(ml.AT_ONCE, timeout=30)
    assert ml.by_window(lambda w: (together.wait(), w * w)[1], list(range(ml.AT_ONCE))) == [w * w for w in range(ml.AT_ONCE)]
