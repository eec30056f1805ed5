"""Rolling windows, style factors and preprocessing on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import by_date, div, ew_kernel, r6, rank_avg, rank_first, rolling, weighted_mean
from ..operators import factors as X
from ..sources.panel import day_panel, month_panel
from .registry import avg_rank, pct, query, r, roll

W = "window w as (partition by ticker order by date_idx)"


def out(df, col="value"):
    return df.select("ticker", "trade_date", r6(col).alias("value"))


def one(sql: str) -> str:
    return f"select ticker, trade_date, {r(sql)} as value from panel"


for _n, _agg, _sql, _x in (("roll_mean", F.avg, "avg({})", "ret"), ("roll_std", F.stddev, "stddev_samp({})", "ret"), ("roll_sum", F.sum, "sum({})", "volume")):

    def _make(agg=_agg, x=_x):
        return lambda spark, sf: out(month_panel(spark, sf).withColumn("value", rolling(agg, x, 5)))

    query(_n, one(roll(_sql, _x, 5)))(_make())


@query("roll_gaps", f"select ticker, trade_date, {r(roll('avg({})', 'close', 3))} as full_window, {r(roll('avg({})', 'close', 5, 2))} as some from day", day=True, month=False)
def roll_gaps(spark, sf):
    return day_panel(spark, sf).select("ticker", "trade_date", r6(rolling(F.avg, "close", 3)).alias("full_window"), r6(rolling(F.avg, "close", 5, 2)).alias("some"))


@query("roll_hilo", one(f"({roll('max({})', 'high', 5)}) / nullif({roll('min({})', 'low', 5)}, 0)"))
def roll_hilo(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.high_low(5)))


RS = "over (partition by ticker order by date_idx rows between 19 preceding and current row)"


@query("roll_quantile", f"select ticker, trade_date, {r(f'case when count(ret) {RS} >= 5 then quantile_cont(ret, 0.75) {RS} end')} as q75, {r(f'case when count(ret) {RS} >= 5 then quantile_cont(ret, 0.25) {RS} end')} as q25 from panel")
def roll_quantile(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", *[r6(rolling(lambda c, p=p: F.percentile(c, F.lit(p)), "ret", 20, 5)).alias(n) for n, p in (("q75", 0.75), ("q25", 0.25))])


def kernel_sql(x: str, n: int, hl: float) -> str:
    d = 0.5 ** (1 / hl)
    total = sum(d**j for j in range(n))
    return "(" + " + ".join(f"lag({x}, {j}) over w * {d**j!r}" for j in range(n)) + f") / {total!r}"


@query("ew_kernel", f"select ticker, trade_date, {r(kernel_sql('ret', 5, 2))} as value from panel {W}")
def ew_kernel_q(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", ew_kernel("ret", 5, 2)))


@query("fac_reversal", f"select ticker, trade_date, {r('case when open is not null then ' + kernel_sql('ret', 10, 5) + ' end')} as value from panel {W}")
def fac_reversal(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.reversal(10, 5)))


@query("fac_momentum", f"with o as (select *, lag(ret, 2) over (partition by ticker order by date_idx) as old from panel) select ticker, trade_date, {r(kernel_sql('old', 12, 6))} as value from o {W}")
def fac_momentum(spark, sf):
    return out(X.lagged_momentum(month_panel(spark, sf), 12, 6, 2))


@query("fac_volatility", one(roll("stddev_samp({})", "close / nullif(preclose, 0)", 10)))
def fac_volatility(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.volatility(10)))


@query("fac_turnover", one(roll("avg({})", "turnover", 5)))
def fac_turnover(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.turnover(5)))


@query("fac_weighted_momentum", one(f"({roll('avg({})', 'turnover * ret', 5)}) / nullif({roll('avg({})', 'turnover', 5)}, 0)"))
def fac_weighted_momentum(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.weighted_momentum(5)))


@query("fac_size", one("case when cap > 0 then log10(cap) end"))
def fac_size(spark, sf):
    return out(month_panel(spark, sf).withColumn("value", X.size()))


@query("fac_industry_momentum", f"with o as (select *, (1 - 1.0::double / count(*) over g) * (avg(coalesce(ret, 0)) over g - coalesce(ret, 0) / count(*) over g) as own from panel window g as (partition by trade_date, industry)) select ticker, trade_date, {r(roll('avg({})', 'own', 5))} as value from o")
def fac_industry_momentum(spark, sf):
    return out(X.industry_momentum(month_panel(spark, sf), 5))


@query("fac_nonlinear_size", f"with o as (select *, case when cap > 0 then ln(cap) end as s from panel), m as (select trade_date, covar_samp(s * s * s, s) / nullif(var_pop(s), 0) as beta from o group by 1) select ticker, o.trade_date, round(s * s * s - beta * s + 1e-9, 4) as value from o join m using (trade_date)")
def fac_nonlinear_size(spark, sf):
    return X.nonlinear_size(month_panel(spark, sf)).select("ticker", "trade_date", F.round(F.col("value") + 1e-9, 4).alias("value"))


CAPM = """with o as (select *, lag(cap) over (partition by ticker order by date_idx) as old_cap from panel), mk as (select trade_date, sum(ret * old_cap) / nullif(sum(case when ret is not null then old_cap end), 0) as mkt from o group by 1),
b as (select ticker, trade_date, date_idx, case when ret is not null and mkt is not null then ret end as x, case when ret is not null and mkt is not null then mkt end as m from panel join mk using (trade_date)),
c as (select ticker, trade_date, case when count(x) over w >= 8 then covar_samp(x, m) over w / nullif(var_pop(x) over w, 0) end as beta, avg(m) over w as am, avg(x) over w as ax, var_pop(m) over w as vm, var_pop(x) over w as vx, covar_pop(x, m) over w as cv
 from b window w as (partition by ticker order by date_idx rows between 20 preceding and 1 preceding))"""


@query("fac_capm", CAPM + f" select ticker, trade_date, {r('beta')} as beta, {r('am - beta * ax')} as alpha, {r('sqrt(greatest(vm + beta * beta * vx - 2 * beta * cv, 0))')} as err_std from c where beta is not null")
def fac_capm(spark, sf):
    return X.capm(month_panel(spark, sf), 20, 8).where("beta is not null").select("ticker", "trade_date", *[r6(c).alias(c) for c in ("beta", "alpha", "err_std")])


TRIM = f"with o as (select *, lag(ret) over (partition by ticker order by date_idx) as x0 from panel), q as (select *, {pct('x0', 0.01)} as lo, {pct('x0', 0.99)} as hi from o), t as (select *, case when x0 between lo and hi then x0 end as x from q)"


@query("fac_trim_norm", TRIM + f" select ticker, trade_date, {r('(x - sum(x * cap) over d / nullif(sum(case when x is not null then cap end) over d, 0)) / nullif(stddev_samp(x) over d, 0)')} as value from t window d as (partition by trade_date)")
def fac_trim_norm(spark, sf):
    return out(X.trimmed_normal(month_panel(spark, sf), "ret"))


@query("fac_class_merge", f"with o as (select *, (coalesce(ret, 0) + coalesce(turnover, 0)) / nullif((ret is not null)::int + (turnover is not null)::int, 0) as x from panel) select ticker, trade_date, {r('(x - sum(x * cap) over d / nullif(sum(case when x is not null then cap end) over d, 0)) / nullif(stddev_samp(x) over d, 0)')} as value from o window d as (partition by trade_date)")
def fac_class_merge(spark, sf):
    return out(X.merged(month_panel(spark, sf), ["ret", "turnover"]))


@query("fac_for_regression", f"with q as (select *, {pct('ret', 0.05)} as lo, {pct('ret', 0.95)} as hi from panel), t as (select *, case when ret between lo and hi then ret end as x from q) select ticker, trade_date, {r('coalesce((x - avg(x) over d) / nullif(stddev_samp(x) over d, 0), 0)')} as value from t window d as (partition by trade_date)")
def fac_for_regression(spark, sf):
    return out(X.for_regression(month_panel(spark, sf), "ret"))


@query("fac_registry", f"select ticker, trade_date, {r('vwap / nullif(lag(vwap, 3) over w, 0) - 1')} as mom_3, {r('vwap / nullif(lag(vwap, 6) over w, 0) - 1')} as mom_6 from panel {W}")
def fac_registry(spark, sf):
    return X.compute(month_panel(spark, sf), ["mom"]).select("ticker", "trade_date", r6("mom_3").alias("mom_3"), r6("mom_6").alias("mom_6"))


def clip_sql(lo: str, hi: str) -> str:
    return f"select ticker, trade_date, {r(f'case when ret is not null then least(greatest(ret, {lo}), {hi}) end')} as value from q"


@query("wins_quantile", f"with q as (select *, {pct('ret', 0.05)} as lo, {pct('ret', 0.95)} as hi from panel) " + clip_sql("lo", "hi"))
def wins_quantile(spark, sf):
    return out(X.winsorize(month_panel(spark, sf), "ret", "quantile"))


@query("wins_3sigma", "with q as (select *, median(ret) over d as m, 1.0 * stddev_samp(ret) over d as k from panel window d as (partition by trade_date)) " + clip_sql("m - k", "m + k"))
def wins_3sigma(spark, sf):
    return out(X.winsorize(month_panel(spark, sf), "ret", "sigma", 1.0))


@query("wins_mad", "with o as (select *, abs(ret - avg(ret) over (partition by trade_date)) as dev from panel), q as (select *, median(ret) over d as m, 1.483 * avg(dev) over d as k from o window d as (partition by trade_date)) " + clip_sql("m - k", "m + k"))
def wins_mad(spark, sf):
    return out(X.winsorize(month_panel(spark, sf), "ret", "mad", 1.0))


@query("std_z", one("(ret - avg(ret) over (partition by trade_date)) / nullif(stddev_samp(ret) over (partition by trade_date), 0)"))
def std_z(spark, sf):
    return out(X.standardize(month_panel(spark, sf), "ret", "z"))


@query("std_rank", f"with o as (select *, {avg_rank('ret')} as k from panel) select ticker, trade_date, {r('(k - avg(k) over (partition by trade_date)) / nullif(stddev_samp(k) over (partition by trade_date), 0)')} as value from o")
def std_rank(spark, sf):
    return out(X.standardize(month_panel(spark, sf), "ret", "rank"))


NEUTRAL = "with p as (select *, case when ret is not null and cap > 0 then ret end as a, case when ret is not null and cap > 0 then ln(cap) end as b from panel), e as (select *, a - avg(a) over d - covar_pop(a, b) over d / nullif(var_pop(b) over d, 0) * (b - avg(b) over d) as res from p window d as (partition by trade_date))"


@query("neutralize", NEUTRAL + f" select ticker, trade_date, {r('(res - avg(res) over g) / nullif(stddev_samp(res) over g, 0)')} as value from e where region is not null window g as (partition by trade_date, region)")
def neutralize_q(spark, sf):
    return out(X.neutralize(month_panel(spark, sf), "ret", group="region"))


PROCESS = f"""o as (select *, abs(ret - avg(ret) over (partition by trade_date)) as dev from panel), q as (select *, median(ret) over d as m, 3 * 1.483 * avg(dev) over d as k from o window d as (partition by trade_date)),
c as (select *, case when ret is not null and cap > 0 then least(greatest(ret, m - k), m + k) end as a, case when ret is not null and cap > 0 then ln(cap) end as b from q),
e as (select *, a - avg(a) over d - covar_pop(a, b) over d / nullif(var_pop(b) over d, 0) * (b - avg(b) over d) as res from c window d as (partition by trade_date)),
w as (select *, (res - avg(res) over g) / nullif(stddev_samp(res) over g, 0) as w2 from e window g as (partition by trade_date, industry))"""


@query("fac_process", f"with {PROCESS} select ticker, trade_date, {r('(w2 - avg(w2) over d) / nullif(stddev_samp(w2) over d, 0)')} as value from w window d as (partition by trade_date)")
def fac_process(spark, sf):
    return out(X.process(month_panel(spark, sf), "ret"))


@query("capw_mean", f"select trade_date, {r('sum(ret * cap) / nullif(sum(case when ret is not null then cap end), 0)')} as m from panel group by 1")
def capw_mean(spark, sf):
    return month_panel(spark, sf).groupBy("trade_date").agg(r6(weighted_mean("ret", "cap")).alias("m"))


@query("rank_first", "select ticker, trade_date, case when vwap is not null then row_number() over (partition by trade_date order by vwap nulls last, ticker) end as rk from panel")
def rank_first_q(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", rank_first("vwap").alias("rk"))


@query("rank_avg", f"with p as (select *, floor(volume / 50) as lots from panel) select ticker, trade_date, {avg_rank('lots', True)}::double as rk from p")
def rank_avg_q(spark, sf):
    p = month_panel(spark, sf).withColumn("lots", F.floor(F.col("volume") / 50))
    return p.select("ticker", "trade_date", rank_avg("lots", True).cast("double").alias("rk"))


@query("scaled_rank", f"select ticker, trade_date, {r('rank() over (partition by trade_date order by ret) / (count(*) over (partition by trade_date))::double')} as share, {r('percent_rank() over (partition by trade_date order by ret)')} as pr from panel where ret is not null")
def scaled_rank(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("trade_date").orderBy("ret")
    p = month_panel(spark, sf).where("ret is not null")
    return p.select("ticker", "trade_date", r6(F.rank().over(w) / F.count("*").over(by_date())).alias("share"), r6(F.percent_rank().over(w)).alias("pr"))


@query("qcut_groups", "with q as (select *, " + ", ".join(f"quantile_cont(cap, {i / 10}) over (partition by trade_date) as q{i}" for i in range(1, 10)) + " from panel where cap is not null) select ticker, trade_date, cast(" + " + ".join(f"(cap > q{i})::int" for i in range(1, 10)) + " as bigint) as grp from q")
def qcut_groups(spark, sf):
    p = month_panel(spark, sf).where("cap is not null").withColumn("q", F.percentile("cap", [i / 10 for i in range(1, 10)]).over(by_date()))
    return p.select("ticker", "trade_date", F.size(F.filter("q", lambda e: F.col("cap") > e)).cast("long").alias("grp"))


@query("roll_prod", f"select ticker, trade_date, {r('exp(sum(ln(1 + ret)) over (partition by ticker order by date_idx rows between 2 preceding and current row)) - 1')} as value from panel")
def roll_prod(spark, sf):
    from ..functions.expr import rows

    return out(month_panel(spark, sf).withColumn("value", F.exp(F.sum(F.log1p("ret")).over(rows(3))) - 1))


@query("drop_sparse", "select ticker, trade_date, (ret is null)::int + (open is null)::int + (turnover is null)::int as n_null from panel where (ret is null)::int + (open is null)::int + (turnover is null)::int <= 0.3 * 3")
def drop_sparse(spark, sf):
    n = sum(F.col(c).isNull().cast("int") for c in ("ret", "open", "turnover"))
    return month_panel(spark, sf).withColumn("n_null", n).where("n_null <= 0.3 * 3").select("ticker", "trade_date", "n_null")


@query("feat_winsorize", f"with s as (select quantile_cont(ret, 0.5) as med, quantile_cont(ret, 0.9) - quantile_cont(ret, 0.1) as rg from panel where date_idx < 48) select ticker, trade_date, {r('case when date_idx >= 48 then case when ret is not null then least(greatest(ret, med - 2.5 * rg), med + 2.5 * rg) end when abs(ret - med) <= 4 * rg then least(greatest(ret, med - 2.5 * rg), med + 2.5 * rg) end')} as value from panel cross join s")
def feat_winsorize(spark, sf):
    from ..operators.ml import winsorize_features

    return out(winsorize_features(month_panel(spark, sf), ["ret"], 48), "ret_w")
