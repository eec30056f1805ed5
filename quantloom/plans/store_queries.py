"""Histories, covariances and returns that are written once and read by their keys and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import risk as K
from ..sources.history import History, fund_cells, index_cells
from ..sources.panel import month_panel
from ..sources.store import Store, kept_in, require
from .model_queries import FACTOR_COV, RES, WLS, factor_series, residuals, styled
from .registry import query, r

RANGE, NAMES = ("1997-03-01", "1999-06-30"), ("000001", "000003", "000007", "index1", "index3")


def history(spark, sf) -> History:
    """The histories over one folder of tables; what was written before is left."""
    h = History(spark, kept_in(spark, sf))
    cells = {"stock": lambda: month_panel(spark, sf), "index": lambda: index_cells(month_panel(spark, sf)), "fund": lambda: fund_cells(spark, sf)}
    for source, make in cells.items():
        if not h.written(source):
            h.write(source, make())
    return h


def rounded(df, *fields):
    return df.select("ticker", "trade_date", *[r6(f).alias(f) for f in fields])


IN = f"trade_date between '{RANGE[0]}' and '{RANGE[1]}'"
LISTED = f"ticker in ({', '.join(map(repr, NAMES))})"


@query("history_stock", f"select ticker, trade_date, {r('close')} as close, {r('vwap')} as vwap from panel where {IN} and {LISTED}")
def history_stock(spark, sf):
    return rounded(history(spark, sf).scan(["close", "vwap"], NAMES, *RANGE), "close", "vwap")


_MEAN = ", ".join(f"{r(f'sum({c} * value) / nullif(sum(case when {c} is not null then value end), 0)')} as {c}" for c in ("open", "high", "low", "close", "preclose"))


@query("history_index", f"select * from (select 'index' || region as ticker, trade_date, {_MEAN}, {r('sum(volume)')} as volume, {r('sum(value)')} as value from panel where region is not null group by all) where {IN} and {LISTED}")
def history_index(spark, sf):
    return rounded(history(spark, sf).scan(tickers=NAMES, start=RANGE[0], end=RANGE[1], source="index"), "open", "high", "low", "close", "preclose", "volume", "value")


@query("history_fund", f"select lpad(cast(o_custkey as varchar), 6, '0') as ticker, cast(date_trunc('month', o_orderdate) as date) as trade_date, {r('sum(o_totalprice)')} as equity from orders group by all having {IN.replace('trade_date', 'min(o_orderdate)').replace('1999-06-30', '1999-06-30 23:59:59')}", month=False)
def history_fund(spark, sf):
    return rounded(history(spark, sf).scan(start=RANGE[0], end=RANGE[1], source="fund"), "equity")


@query("strict_lookup", f"select ticker, trade_date, {r('close')} as close from panel where region = 1")
def strict_lookup(spark, sf):
    p = month_panel(spark, sf)
    return rounded(require(p, p.where("region = 1")), "close")


def kept_covariance(spark, sf) -> Store:
    """Raw factor covariances of all dates, kept by month."""
    store = Store(spark, kept_in(spark, sf))
    if not store.has("covariance_dates", adj_chain="raw", ret_type="factor"):
        store.keep_dated("covariance", K.factor_covariance(factor_series(spark, sf).where("kind = 'factor'"), 24, 12), adj_chain="raw", ret_type="factor")
    return store


def mid_months(spark, sf):
    """The 15th of every third month: dates on which no covariance was estimated."""
    return month_panel(spark, sf).where("date_idx % 3 = 1").select(F.date_add("trade_date", 14).alias("asked_date")).distinct()


@query("cov_asof", f"""with {FACTOR_COV}, c as (select a.trade_date, a.name as i, b.name as j, sum((1 - abs(a.d - b.d) / 5.0) * case when a.d >= b.d then a.w else b.w end * a.z * b.z) as value from z a join z b on a.e = b.e and abs(a.d - b.d) <= 4 group by all),
asked as (select distinct trade_date + 14 as asked_date from panel where date_idx % 3 = 1), met as (select asked_date, max(trade_date) as trade_date from asked join (select distinct trade_date from c) on trade_date <= asked_date group by 1)
select cast(asked_date as date) as asked_date, trade_date, i, j, {r('value')} as value from met join c using (trade_date)""")
def cov_asof(spark, sf):
    got = kept_covariance(spark, sf).asof("covariance", mid_months(spark, sf), adj_chain="raw", ret_type="factor")
    return got.select("asked_date", "trade_date", "i", "j", r6("value").alias("value"))


def kept_returns(spark, sf) -> Store:
    """Factor returns and residuals of all dates."""
    store = Store(spark, kept_in(spark, sf))
    if not store.has("factor_return", ret_type="idio"):
        for kind in ("factor", "idio"):
            store.write("factor_return", factor_series(spark, sf).where(F.col("kind") == kind).select("trade_date", "date_idx", "name", "value"), ret_type=kind)
    return store


@query("returns_kept", f"with {WLS} select trade_date, name, {r('min(value)')} as value from wls_f where trade_date between '1997-03-01' and '1999-06-30' group by all")
def returns_kept(spark, sf):
    return kept_returns(spark, sf).read("factor_return", dates=RANGE, ret_type="factor").select("trade_date", "name", r6("value").alias("value"))


@query("idio_aligned", f"with {WLS} select p.ticker, p.trade_date, {r('case when p.cap is not null then ret - fitted end')} as value from panel p left join (select ticker, trade_date, ret, fitted from wls) w using (ticker, trade_date)".replace("ret - fitted end", "w.ret - w.fitted end"))
def idio_aligned(spark, sf):
    """Residuals on the panel's dates and tickers, where there is a market value."""
    idio = kept_returns(spark, sf).read("factor_return", ret_type="idio").select(F.col("name").alias("ticker"), "trade_date", "value")
    p = month_panel(spark, sf).select("ticker", "trade_date", "cap").join(idio, ["ticker", "trade_date"], "left")
    return p.select("ticker", "trade_date", r6(F.when(F.col("cap").isNotNull(), F.col("value"))).alias("value"))


_NW = f"""{RES}, v as (select ticker, date_idx, value from res), n as (select e.ticker, e.trade_date, e.date_idx as e, a.date_idx as d, a.value as x, pow(0.5, (e.date_idx - a.date_idx) / 12.0) / (select sum(pow(0.5, k / 12.0)) from range(24) t(k)) as w from res e join v a on a.ticker = e.ticker and a.date_idx between e.date_idx - 23 and e.date_idx),
m as (select ticker, e, count(x) as n, sum(w * x) / count(x) as m from n group by all having count(x) >= 12), z as (select n.ticker, n.trade_date, n.e, n.d, n.w, n.x - m.m as z from n join m using (ticker, e) where x is not null),
nw as (select a.ticker, a.trade_date, greatest(sum(case when a.d = b.d then 1 else 2 * (1 - (a.d - b.d) / 5.0) end * a.w * a.z * b.z), 0) as var from z a join z b on a.ticker = b.ticker and a.e = b.e and a.d - b.d between 0 and 4 group by all)"""


@query("idio_newey_west", f"with {_NW} select ticker, trade_date, {r('var')} as var from nw")
def idio_newey_west(spark, sf):
    return K.idio_newey_west(residuals(spark, sf), 24, 12, 12).where("var is not null").select("ticker", "trade_date", r6("var").alias("var"))
