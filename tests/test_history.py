"""Histories, kept covariances and residual variances: what is read, and without Python workers."""

import io
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import risk
from quantloom.sources.history import History
from quantloom.sources.store import Store


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    h = History(spark, str(tmp_path_factory.mktemp("history")))
    rows = spark.range(6_000).selectExpr("lpad(cast(id % 50 as string), 6, '0') ticker", "date_add(date'2015-01-01', cast(id div 50 as int) * 20) trade_date", "id * 1.5d equity", "id other")
    h.write("fund", rows)
    return h


def test_scan_reads_what_it_is_asked_for(history):
    got = history.scan(["equity"], ["000003", "000004", "none"], "2017-03-01", "2018-02-28", "fund")
    text = plan(got)
    assert re.search(r"PartitionFilters: \[.*year#\d+ >= 2017.*year#\d+ <= 2018", text)
    assert re.search(r"PushedFilters: \[.*In\(ticker.*LessThanOrEqual\(trade_date|PushedFilters: \[.*trade_date.*In\(ticker", text)
    assert "ReadSchema: struct<ticker:string,trade_date:date,equity:double>" in text
    rows = got.collect()
    assert {r.ticker for r in rows} == {"000003", "000004"} and {r.trade_date.year for r in rows} == {2017, 2018}
    years = lambda df: {r[0] for r in df.select(F.regexp_extract(F.input_file_name(), r"year=(\d+)", 1)).distinct().collect()}
    assert years(got) == {"2017", "2018"} < years(history.scan(source="fund"))
    assert history.scan(source="fund").count() == 6_000
    assert history.scan(tickers=got.select("ticker"), source="fund").count() == 2 * 120


def test_scan_refuses_what_it_does_not_know(history):
    with pytest.raises(ValueError):
        history.scan(["close"], source="fund")
    with pytest.raises(ValueError):
        history.scan(source="bond")


def test_writing_a_year_keeps_the_others(spark, tmp_path):
    h = History(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(rows, "ticker string, trade_date string, equity double").withColumn("trade_date", F.col("trade_date").cast("date"))
    h.write("fund", make(("a", "2020-01-02", 1.0), ("a", "2021-01-02", 2.0), (None, "2021-01-02", 3.0), ("b", None, 3.0)))
    h.write("fund", make(("a", "2021-01-02", 5.0)))
    assert sorted((r.ticker, r.equity) for r in h.scan(source="fund").collect()) == [("a", 1.0), ("a", 5.0)]


def test_asof_prunes_months(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(400).selectExpr("date_add(date'2020-01-01', cast(id as int)) trade_date", "'x' i", "'y' j", "id * 1d value").where("day(trade_date) <= 20")
    store.keep_dated("covariance", rows, adj_chain="raw", ret_type="factor")
    assert store.has("covariance_dates", adj_chain="raw", ret_type="factor") and not store.has("covariance_dates", adj_chain="eigen", ret_type="factor")
    asked = spark.createDataFrame([("2019-12-31",), ("2020-01-05",), ("2020-01-31",), ("2020-07-20",), ("2030-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("asked_date"))
    got = store.asof("covariance", asked, adj_chain="raw", ret_type="factor")
    assert sorted((str(r.asked_date), str(r.trade_date)) for r in got.collect()) == [("2020-01-05", "2020-01-05"), ("2020-01-31", "2020-01-20"), ("2020-07-20", "2020-07-20"), ("2030-01-01", "2021-02-03")]
    text = plan(got)
    assert "dynamicpruning" in text and re.search(r"PartitionFilters: \[.*adj_chain.*month", text)


def test_newey_west_equals_a_loop_without_python_workers(spark):
    rng, h, least, lags = np.random.default_rng(5), 12, 5, 4
    rows = [(f"t{k}", t, None if rng.random() < (0.2 if k else 0.95) else float(rng.normal() + k)) for k in range(4) for t in range(40)]
    frame = spark.createDataFrame(rows, "ticker string, date_idx int, value double").withColumn("trade_date", F.expr("date_add(date'2020-01-01', date_idx)"))
    got = risk.idio_newey_west(frame, h, 6, least, lags, 2)
    assert not re.search("InPandas|InArrow|EvalPython", plan(got))
    w = risk.ew_weights(h, 6)
    for r in got.collect():
        x = np.array([np.nan if v is None else v for t, d, v in rows if t == r.ticker and r.date_idx - h < d <= r.date_idx])
        ok, own = ~np.isnan(x), w[-len(x) :]
        if ok.sum() < least:
            assert r["var"] is None
            continue
        z = np.where(ok, x - (own * np.where(ok, x, 0)).sum() / ok.sum(), 0.0)
        want = (own * z * z).sum() + sum(2 * (1 - k / (lags + 1)) * (own[k:] * z[k:] * z[:-k]).sum() for k in range(1, min(lags, len(z) - 1) + 1))
        assert r["var"] == pytest.approx(2 * max(want, 0), abs=1e-12)
