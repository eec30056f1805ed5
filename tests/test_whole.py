"""Queries without SQL cover all tickers and dates of their panel."""

from pyspark.sql import functions as F

from quantloom.plans import model_queries as M
from quantloom.plans.registry import QUERIES
from quantloom.sources.panel import month_panel

SF = "/root/testdata/sf0.001"


def test_portfolios_cover_all_regions_and_dates(spark):
    cells = M.opt_cells(spark, SF).dropna()
    want = {(r.trade_date, r.ticker) for r in cells.select("trade_date", "ticker").collect()}
    assert len({r.region for r in month_panel(spark, SF).select("region").distinct().collect()}) == cells.select("industry").distinct().count()
    per_day = {}
    for d, t in want:
        per_day.setdefault(d, set()).add(t)
    days = sorted(per_day)[3:]
    got = {(r.trade_date, r.ticker) for r in QUERIES["qp1"](spark, SF).collect()}
    assert got == {(d, t) for d in days if len(per_day[d]) >= 5 for t in per_day[d]}


def test_windows_and_graphs_cover_the_panel(spark):
    p = month_panel(spark, SF)
    got = M.windows(spark, SF)
    n = p.select("date_idx").distinct().count()
    tested = [i for _, _, _, lo, hi in got for i in range(lo, hi + 1)]
    assert tested == list(range(37, n))  # every date after the first training and its delay, once
    tickers = {r.ticker for r in p.select("ticker").distinct().collect()}
    nodes = {x for r in QUERIES["mst_edges"](spark, SF).collect() for x in r.asDict().values() if x in tickers}
    assert nodes == tickers
    labels = {r.ticker for r in QUERIES["cluster_complete"](spark, SF).where("label >= 0").collect()}
    assert labels == tickers


def test_month_panel_moves_lines_once_by_ticker(spark):
    """No exchange by ticker and date: dates without lines come in the same exchange as the lines."""
    import re

    text = month_panel(spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = [k for k in re.findall(r"hashpartitioning\(([^)]*)\)", text) if "ticker" in k]
    assert keys and not any("trade_date" in k for k in keys)


def test_month_panel_is_dense_with_odd_lines(spark, tmp_path):
    """Lines without a date add no date, those without a supplier a ticker without cells."""
    lines = spark.createDataFrame([(1, 1, 1, 1, 2.0, 8.0, "1995-01-05"), (1, 1, 1, 2, 2.0, 6.0, "1995-03-05"), (2, 1, 2, 1, 1.0, 5.0, None), (3, 1, None, 1, 1.0, 5.0, "1995-03-01")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string")
    lines.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("supplier", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {(r.ticker, str(r.trade_date), r.date_idx, r.close) for r in month_panel(spark, str(tmp_path)).collect()}
    dates = (("1995-01-01", 0), ("1995-03-01", 1))
    assert got == {("000001", *dates[0], 4.0), ("000001", *dates[1], 3.0)} | {(t, *d, None) for t in ("000002", None) for d in dates}


def test_partitions_of_the_month_panel_follow_the_lines(spark, monkeypatch):
    """A task sorts PART_LINES lines, however many there are in all; the cells stay the same."""
    from quantloom.sources import panel

    lines = panel.table(spark, SF, "lineitem")
    few = panel.month_cells(lines)
    monkeypatch.setattr(panel, "PART_LINES", 300)
    many = panel.month_cells(lines)
    assert many.rdd.getNumPartitions() == -(-lines.count() // 300) > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, few.collect()), key=str)
