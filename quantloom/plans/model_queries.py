"""Regressions, risk model, portfolios, learning and clustering on the monthly panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import by_date, by_ticker, div, r6
from ..operators import calendar as C
from ..operators import factors as X
from ..operators import graph as G
from ..operators import ml as L
from ..operators import optimize as O
from ..operators import regress as R
from ..operators import risk as K
from ..sources.panel import month_panel
from ..sources.store import Store, kept_in
from .registry import corr, query, r


def styled(spark, sf):
    """Panel with two standardised styles."""
    p = month_panel(spark, sf).withColumns({"size": X.size(), "mom": X.mom(3)})
    for x in ("size", "mom"):
        p = p.withColumn(f"s_{x}", F.coalesce(div(F.col(x) - F.avg(x).over(by_date()), F.stddev(x).over(by_date())), F.lit(0.0)))
    return p


STYLED = "st0 as (select *, case when cap > 0 then log10(cap) end as size, vwap / nullif(lag(vwap, 3) over w, 0) - 1 as mom from panel window w as (partition by ticker order by date_idx)), styled as (select *, " + ", ".join(f"coalesce(({x} - avg({x}) over d) / nullif(stddev_samp({x}) over d, 0), 0) as s_{x}" for x in ("size", "mom")) + " from st0 window d as (partition by trade_date))"


def least_squares(name: str, rows: str, group: str, weight: str, keep: str = "") -> str:
    """SQL of ret on both styles and dummies of ``group``, weighted: means within groups come off first, then two unknowns are left. A style that the rest explains gets 0."""
    mean = ", ".join(f"sum({weight} * {x}) over g / sum({weight}) over g as {m}" for x, m in (("ret", "my"), ("s_size", "m1"), ("s_mom", "m2"))) if group else "0.0 as my, 0.0 as m1, 0.0 as m2"
    window = f" window g as (partition by trade_date, {group})" if group else ""
    return f"""{name}_r as (select trade_date, date_idx, ticker, ret, s_size, s_mom, {keep or 'region'}, {weight} as wt from {rows} where ret is not null and {weight} > 0),
{name}_m as (select *, {mean.replace(weight, 'wt') if weight != '1' else mean} from {name}_r{window}),
{name}_s as (select trade_date, count(*) as n, sum(wt * (s_size - m1) * (s_size - m1)) as a11, sum(wt * (s_size - m1) * (s_mom - m2)) as a12, sum(wt * (s_mom - m2) * (s_mom - m2)) as a22, sum(wt * (s_size - m1) * (ret - my)) as c1, sum(wt * (s_mom - m2) * (ret - my)) as c2, sum(wt) as total from {name}_m group by 1),
{name}_b as (select trade_date, case when a11 <= 1e-12 * total then 0 when a22 <= 1e-12 * total or a11 * a22 - a12 * a12 <= 1e-10 * a11 * a22 then c1 / a11 else (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) end as b1,
 case when a22 <= 1e-12 * total then 0 when a11 <= 1e-12 * total then c2 / a22 when a11 * a22 - a12 * a12 <= 1e-10 * a11 * a22 then 0 else (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) end as b2 from {name}_s where n >= 2),
{name} as (select m.*, b1, b2, my + b1 * (s_size - m1) + b2 * (s_mom - m2) as fitted from {name}_m m join {name}_b using (trade_date))"""


OLS = f"{STYLED}, {least_squares('ols', 'styled', '', '1')}"
WLS = f"""{STYLED}, {least_squares('wls', 'styled', 'region', 'cap')},
wls_f as (select distinct trade_date, date_idx, unnest(['s_size', 's_mom', 'region_' || region]) as name, unnest([b1, b2, my - b1 * m1 - b2 * m2]) as value from wls)"""


@query("ols_factor_ret", f"with {OLS} select trade_date, unnest(['s_size', 's_mom']) as name, unnest([{r('b1')}, {r('b2')}]) as value from ols_b")
def ols_factor_ret(spark, sf):
    return R.factor_returns(styled(spark, sf), "ret", ["s_size", "s_mom"]).where("kind = 'factor'").select("trade_date", "name", r6("value").alias("value"))


@query("wls_factor_ret", f"with {WLS} select trade_date, 'factor' as kind, name, {r('min(value)')} as value from wls_f group by trade_date, name union all select trade_date, 'idio', ticker, {r('ret - fitted')} from wls")
def wls_factor_ret(spark, sf):
    return R.factor_returns(styled(spark, sf), "ret", ["s_size", "s_mom"], "region", "cap").select("trade_date", "kind", "name", r6("value").alias("value"))


@query("two_step_attr", f"with {STYLED}, {least_squares('two', 'styled', 'industry', '1', 'region, industry')} select trade_date, ticker, {r('fitted')} as fitted, {r('avg(ret - fitted) over (partition by trade_date, region)')} as plate_fit from two")
def two_step_attr(spark, sf):
    return R.two_step(styled(spark, sf), "ret", ["s_size", "s_mom"], "industry", "region").select("trade_date", "ticker", r6("fitted").alias("fitted"), r6("plate_fit").alias("plate_fit"))


def factor_series(spark, sf):
    got = R.factor_returns(styled(spark, sf), "ret", ["s_size", "s_mom"], "region", "cap")
    cal = F.broadcast(month_panel(spark, sf).select("trade_date", "date_idx").distinct())
    return got.join(cal, "trade_date")


FACTOR_COV = f"""{WLS}, fr as (select trade_date, date_idx, name, min(value) as value from wls_f group by all),
win as (select e.trade_date, e.date_idx as e, f.date_idx as d, name, value, pow(0.5, (e.date_idx - f.date_idx) / 12.0) / (select sum(pow(0.5, k / 12.0)) from range(24) t(k)) as w from (select distinct trade_date, date_idx from fr) e join fr f on f.date_idx <= e.date_idx and f.date_idx > e.date_idx - 24),
whole as (select e, avg(w * value) as mean from win group by e having count(distinct d) = 24 and count(*) = 24 * count(distinct name)),
z as (select trade_date, win.e, d, name, w, value - mean as z from win join whole using (e))"""


@query("ew_factor_cov", f"with {FACTOR_COV} select a.trade_date, a.name as i, b.name as j, {r('sum((1 - abs(a.d - b.d) / 5.0) * case when a.d >= b.d then a.w else b.w end * a.z * b.z)')} as value from z a join z b on a.e = b.e and abs(a.d - b.d) <= 4 group by all")
def ew_factor_cov(spark, sf):
    return K.factor_covariance(factor_series(spark, sf).where("kind = 'factor'"), 24, 12).select("trade_date", "i", "j", r6("value").alias("value"))


@query("eigen_adj")
def eigen_adj(spark, sf):
    return K.factor_covariance(factor_series(spark, sf).where("kind = 'factor'"), 24, 12, eigen=True).select("trade_date", "i", "j", F.round("value", 8).alias("value"))


def residuals(spark, sf):
    """Returns less their industry's mean."""
    p = month_panel(spark, sf)
    return p.withColumn("value", F.col("ret") - F.avg("ret").over(Window.partitionBy("trade_date", "industry")))


RES = "res as (select * exclude (value), ret - avg(ret) over (partition by trade_date, industry) as value from panel)"
DECAY = 0.5 ** (1 / 12)
IDIO = f"""{RES}, ew as (select ticker, trade_date, date_idx, count(value) over w as n, sum(case when value is not null then pow({DECAY!r}::double, -date_idx) end) over w as m, sum(pow({DECAY!r}::double, -date_idx) * value) over w as s1, sum(pow({DECAY!r}::double, -date_idx) * value * value) over w as s2
 from res window w as (partition by ticker order by date_idx rows between 23 preceding and current row)), idio as (select ticker, trade_date, date_idx, case when n >= 12 then greatest(s2 / m - pow(s1 / m, 2), 0) end as var from ew)"""


def idio(spark, sf):
    return K.idio_variance(residuals(spark, sf), 24, 12, 12)


@query("idio_variance", f"with {IDIO} select ticker, trade_date, {r('var')} as var from idio")
def idio_variance(spark, sf):
    return idio(spark, sf).select("ticker", "trade_date", r6("var").alias("var"))


ROBUST = f"{RES}, rb as (select ticker, trade_date, case when count(value) over w >= 8 then stddev_samp(value) over w end as std, case when count(value) over w >= 8 then (quantile_cont(value, 0.75) over w - quantile_cont(value, 0.25) over w) / 1.35 end as robust from res window w as (partition by ticker order by date_idx rows between 19 preceding and current row))"


@query("robust_sigma", f"with {ROBUST} select ticker, trade_date, {r('std')} as std, {r('robust')} as robust, {r('least(exp(1 - abs(std / nullif(robust, 0) - 1)), 1)')} as gamma from rb where std is not null")
def robust_sigma(spark, sf):
    return K.robust_sigma(residuals(spark, sf), 20, 8).where("std is not null").select("ticker", "trade_date", *[r6(c).alias(c) for c in ("std", "robust", "gamma")])


#: Weighted least squares of ln(std) on a constant and two styles: means off first.
STRUCT = f"""{ROBUST}, {STYLED.replace('st0 as (select *,', 'st0 as (select panel.*,')}, g0 as (select rb.ticker, rb.trade_date, std, least(exp(1 - abs(std / nullif(robust, 0) - 1)), 1) as gamma, cap, s_size as x1, s_mom as x2 from rb join styled s on s.ticker = rb.ticker and s.trade_date = rb.trade_date),
g as (select *, gamma >= 1 - 1e-12 and std > 0 and cap > 0 as good from g0 where std is not null and gamma is not null and cap is not null),
mm as (select trade_date, count(*) as n, sum(cap * x1) / sum(cap) as m1, sum(cap * x2) / sum(cap) as m2, sum(cap * ln(std)) / sum(cap) as my from g where good group by 1),
ss as (select trade_date, sum(cap * (x1 - m1) * (x1 - m1)) as a11, sum(cap * (x1 - m1) * (x2 - m2)) as a12, sum(cap * (x2 - m2) * (x2 - m2)) as a22, sum(cap * (x1 - m1) * (ln(std) - my)) as c1, sum(cap * (x2 - m2) * (ln(std) - my)) as c2 from g join mm using (trade_date) where good group by 1),
bb as (select trade_date, n, m1, m2, my, (c1 * a22 - c2 * a12) / nullif(a11 * a22 - a12 * a12, 0) as b1, (c2 * a11 - c1 * a12) / nullif(a11 * a22 - a12 * a12, 0) as b2 from mm join ss using (trade_date)),
md as (select g.*, coalesce(n, 0) as n, exp(my + b1 * (x1 - m1) + b2 * (x2 - m2)) as model from g left join bb using (trade_date)),
st as (select *, sum(case when good then cap * std / model end) over d / sum(case when good then cap end) over d as e0 from md window d as (partition by trade_date))"""


@query("struct_adj", f"with {STRUCT} select trade_date, ticker, {r('case when n > 3 then gamma * std + (1 - gamma) * e0 * model else std end')} as sigma from st")
def struct_adj(spark, sf):
    p = K.robust_sigma(residuals(spark, sf), 20, 8).join(styled(spark, sf).select("ticker", "trade_date", "s_size", "s_mom"), ["ticker", "trade_date"])
    return K.structural(p, ["s_size", "s_mom"], "cap").select("trade_date", "ticker", r6("sigma").alias("sigma"))


BAYES = f"""{IDIO}, s as (select i.ticker, i.trade_date, sqrt(var) as sigma, cap from idio i join panel p on p.ticker = i.ticker and p.trade_date = i.trade_date where var is not null and cap is not null),
q as (select *, {' + '.join(f'(cap > quantile_cont(cap, {i / 10}) over (partition by trade_date))::int' for i in range(1, 10))} as grp from s),
g as (select *, sum(sigma * cap) over d / nullif(sum(cap) over d, 0) as mean from q window d as (partition by trade_date, grp)),
v as (select *, sqrt(avg(pow(sigma - mean, 2)) over (partition by trade_date, grp)) as spread, abs(sigma - mean) as away from g),
k as (select *, coalesce(away / nullif(spread + away, 0), 0) as vv from v)"""


@query("bayes_shrink", f"with {BAYES} select ticker, trade_date, cast(grp as integer) as grp, {r('vv * mean + (1 - vv) * sigma')} as shrunk from k")
def bayes_shrink(spark, sf):
    p = idio(spark, sf).join(month_panel(spark, sf).select("ticker", "trade_date", "cap"), ["ticker", "trade_date"]).withColumn("sigma", F.sqrt("var"))
    return K.bayes_shrink(p, "sigma", "cap").select("ticker", "trade_date", "grp", r6("shrunk").alias("shrunk"))


D6 = 0.5 ** (1 / 6)


@query("vol_regime", f"""with {IDIO}, x as (select p.trade_date, p.date_idx, case when avg(pow(ret / nullif(sqrt(var), 0), 2)) >= 100 then 1 else avg(pow(ret / nullif(sqrt(var), 0), 2)) end as b2 from panel p join idio i on i.ticker = p.ticker and i.trade_date = p.trade_date group by all)
select trade_date, {r('b2')} as b2, {r(f'sqrt(sum(pow({D6!r}::double, -date_idx) * b2) over w / sum(case when b2 is not null then pow({D6!r}::double, -date_idx) end) over w)')} as multiplier from x window w as (order by date_idx rows between 11 preceding and current row)""")
def vol_regime(spark, sf):
    p = month_panel(spark, sf).join(idio(spark, sf).select("ticker", "trade_date", F.sqrt("var").alias("sigma")), ["ticker", "trade_date"])
    return K.vol_regime(p, "ret", "sigma", 12, 6).select("trade_date", r6("b2").alias("b2"), r6("multiplier").alias("multiplier"))


def model_covariance(spark, sf):
    """Factor covariances of the regression's factors after all adjustments."""
    return K.adjusted_factor_covariance(factor_series(spark, sf).where("kind = 'factor'"), 24, 12, 4, 1, True, (12, 6))


@query("adjusted_cov")
def adjusted_cov(spark, sf):
    return model_covariance(spark, sf).select("trade_date", "i", "j", F.round("value", 8).alias("value"))


REGIME = f"""{FACTOR_COV}, c as (select a.trade_date, a.name as i, b.name as j, sum((1 - abs(a.d - b.d) / 5.0) * case when a.d >= b.d then a.w else b.w end * a.z * b.z) as value from z a join z b on a.e = b.e and abs(a.d - b.d) <= 4 group by all),
x as (select fr.trade_date, fr.date_idx, avg(pow(fr.value / sqrt(greatest(c.value, 1e-18)), 2)) as b0 from fr join c on c.trade_date = fr.trade_date and c.i = fr.name and c.j = fr.name group by all), y as (select *, case when b0 >= 100 then 1 else b0 end as b2 from x),
rm as (select trade_date, sqrt(sum(pow({D6!r}::double, -date_idx) * b2) over w / sum(case when b2 is not null then pow({D6!r}::double, -date_idx) end) over w) as multiplier from y window w as (order by date_idx rows between 11 preceding and current row))"""


@query("regime_cov", f"with {REGIME} select c.trade_date, i, j, {r('value * coalesce(pow(multiplier, 2), 1)')} as value from c join rm using (trade_date)")
def regime_cov(spark, sf):
    """The chain of factor covariances without its simulated step."""
    got = K.adjusted_factor_covariance(factor_series(spark, sf).where("kind = 'factor'"), 24, 12, 4, 1, False, (12, 6))
    return got.select("trade_date", "i", "j", r6("value").alias("value"))


def kept_model_covariance(spark, sf):
    """The same, estimated once a session and kept by month; for each date of the panel the last one on or before it."""
    store, chain = Store(spark, kept_in(spark, sf)), {"adj_chain": "eigen_vol", "ret_type": "factor"}
    if not store.has("covariance_dates", **chain):
        store.keep_dated("covariance", model_covariance(spark, sf), **chain)
    asked = month_panel(spark, sf).select(F.col("trade_date").alias("asked_date")).distinct()
    return store.asof("covariance", asked, **chain).select(F.col("asked_date").alias("trade_date"), "i", "j", "value")


def model_idio(spark, sf):
    got = factor_series(spark, sf).where("kind = 'idio'").select(F.col("name").alias("ticker"), "trade_date", "date_idx", "value")
    return K.adjusted_idio(got, styled(spark, sf), ["s_size", "s_mom"], "cap", "ret", 24, 12, 12, 4, (20, 8), True, (12, 6))


#: The whole chain of residual variances. Residuals have no rows on dates without a return, so windows go by row.
ADJUSTED = f"""{WLS}, rs as (select ticker, trade_date, date_idx, ret - fitted as value, row_number() over (partition by ticker order by date_idx) as rn from wls),
n as (select e.ticker, e.trade_date, e.rn as e, a.rn as d, a.value as x, pow(0.5, (e.rn - a.rn) / 12.0) / (select sum(pow(0.5, k / 12.0)) from range(24) t(k)) as w from rs e join rs a on a.ticker = e.ticker and a.rn between e.rn - 23 and e.rn),
m as (select ticker, e, sum(w * x) / count(x) as m from n group by all having count(x) >= 12), z as (select n.ticker, n.trade_date, n.e, n.d, n.w, n.x - m.m as z from n join m using (ticker, e)),
nw as (select a.ticker, a.trade_date, sqrt(greatest(sum(case when a.d = b.d then 1 else 2 * (1 - (a.d - b.d) / 5.0) end * a.w * a.z * b.z), 0)) as sigma from z a join z b on a.ticker = b.ticker and a.e = b.e and a.d - b.d between 0 and 4 group by all),
rb as (select ticker, trade_date, case when count(value) over w >= 8 then stddev_samp(value) over w end as std, case when count(value) over w >= 8 then (quantile_cont(value, 0.75) over w - quantile_cont(value, 0.25) over w) / 1.35 end as robust from rs window w as (partition by ticker order by date_idx rows between 19 preceding and current row)),
p0 as (select s.ticker, s.trade_date, s.date_idx, s.ret, s.cap, s.s_size as x1, s.s_mom as x2, sigma, least(exp(1 - abs(std / nullif(robust, 0) - 1)), 1) as gamma from styled s join rb using (ticker, trade_date) left join nw using (ticker, trade_date)),
g as (select *, ln(case when sigma > 0 then sigma end) as y, gamma >= 1 - 1e-12 and sigma > 0 and cap > 0 as good from p0 where sigma is not null and gamma is not null and cap is not null),
mm as (select trade_date, count(*) as n, sum(cap * x1) / sum(cap) as m1, sum(cap * x2) / sum(cap) as m2, sum(cap * y) / sum(cap) as my from g where good group by 1),
ss as (select trade_date, sum(cap * (x1 - m1) * (x1 - m1)) as a11, sum(cap * (x1 - m1) * (x2 - m2)) as a12, sum(cap * (x2 - m2) * (x2 - m2)) as a22, sum(cap * (x1 - m1) * (y - my)) as c1, sum(cap * (x2 - m2) * (y - my)) as c2 from g join mm using (trade_date) where good group by 1),
bb as (select trade_date, n, m1, m2, my, (c1 * a22 - c2 * a12) / nullif(a11 * a22 - a12 * a12, 0) as b1, (c2 * a11 - c1 * a12) / nullif(a11 * a22 - a12 * a12, 0) as b2 from mm join ss using (trade_date)),
md as (select g.*, coalesce(n, 0) as n, exp(my + b1 * (x1 - m1) + b2 * (x2 - m2)) as model from g left join bb using (trade_date)),
e0 as (select *, sum(case when good then cap * sigma / model end) over d / sum(case when good then cap end) over d as e0 from md window d as (partition by trade_date)),
p1 as (select p0.ticker, p0.trade_date, p0.date_idx, p0.ret, p0.cap, coalesce(case when e0.n > 3 then e0.gamma * e0.sigma + (1 - e0.gamma) * e0 * model else e0.sigma end, p0.sigma) as sigma from p0 left join e0 using (ticker, trade_date)),
q as (select *, {' + '.join(f'(cap > quantile_cont(cap, {i / 10}) over (partition by trade_date))::int' for i in range(1, 10))} as grp from p1 where sigma is not null and cap is not null),
h as (select *, sum(sigma * cap) over d / nullif(sum(cap) over d, 0) as mean from q window d as (partition by trade_date, grp)),
v as (select *, sqrt(avg(pow(sigma - mean, 2)) over (partition by trade_date, grp)) as spread, abs(sigma - mean) as away from h),
k as (select ticker, trade_date, coalesce(away / nullif(spread + away, 0), 0) * mean + (1 - coalesce(away / nullif(spread + away, 0), 0)) * sigma as shrunk from v),
p2 as (select p1.ticker, p1.trade_date, p1.date_idx, p1.ret, coalesce(shrunk, sigma) as sigma from p1 left join k using (ticker, trade_date)),
rg as (select trade_date, date_idx, avg(pow(ret / nullif(sigma, 0), 2)) as b0 from p2 group by all), rc as (select *, case when b0 >= 100 then 1 else b0 end as b2 from rg),
rm as (select trade_date, sqrt(sum(pow({D6!r}::double, -date_idx) * b2) over w / sum(case when b2 is not null then pow({D6!r}::double, -date_idx) end) over w) as multiplier from rc window w as (order by date_idx rows between 11 preceding and current row))"""


@query("adjusted_idio", f"with {ADJUSTED} select ticker, p2.trade_date, {r('pow(sigma * coalesce(multiplier, 1), 2)')} as idio from p2 join rm using (trade_date) where sigma is not null")
def adjusted_idio(spark, sf):
    return model_idio(spark, sf).where("idio is not null").select("ticker", "trade_date", r6("idio").alias("idio"))


def opt_cells(spark, sf):
    p = styled(spark, sf).join(model_idio(spark, sf), ["ticker", "trade_date"])
    p = p.withColumn("idio", F.greatest("idio", F.lit(1e-4))).join(F.broadcast(kept_model_covariance(spark, sf).select("trade_date").distinct()), "trade_date")
    return p.select("trade_date", "ticker", (F.col("s_mom") * 0.01).alias("alpha"), "idio", F.col("region").alias("industry"), F.col("cap").alias("bench"), "s_size", "s_mom")


for _m in (1, 2, 3, 4):

    def _qp(m=_m):
        return lambda spark, sf: O.weights(opt_cells(spark, sf), kept_model_covariance(spark, sf), ["s_size", "s_mom"], "region", [(0, m, 0.3, 0.9), (1, m, 0.6, 0.5)]).select("scenario", "trade_date", "ticker", F.round("w", 5).alias("w"), "relaxed")

    query(f"qp{_m}")(_qp())


def windows(spark, sf):
    n = month_panel(spark, sf).select("date_idx").distinct().count()
    return list(C.walk_forward(n, 36, 12, 12, 1))


def walk_sql(reg: float = 0.0, weight: str = "1.0") -> str:
    """CTE ``mt``: the metrics of linear models with two unknowns, whose (weighted) means are taken off; MLlib divides the penalty by the label's deviation."""
    mean = lambda x: f"sum(wt * ({x})) / sum(wt)"
    return f"""w0 as (select *, lead(vwap, 2) over w / nullif(lead(vwap) over w, 0) - 1 as y0 from panel window w as (partition by ticker order by date_idx)),
f as (select ticker, trade_date, date_idx, coalesce(ret, 0) as x1, coalesce(turnover, 0) as x2, 100 * (y0 - avg(y0) over (partition by trade_date)) as y, {weight} as wt from w0),
win as (select cast(k as integer) as window_id, k * 12 as lo, k * 12 + 35 as hi, k * 12 + 37 as tlo, least(k * 12 + 48, n - 1) as thi from (select unnest(range(0, 100)) as k) cross join (select count(*) as n from cal) where k * 12 + 37 < n),
tr as (select window_id, f.* from f join win on date_idx between lo and hi where y is not null),
me as (select window_id, {mean('x1')} as m1, {mean('x2')} as m2, {mean('y')} as my from tr group by 1),
va as (select window_id, any_value(m1) as m1, any_value(m2) as m2, any_value(my) as my, {mean('(x1 - m1) * (x1 - m1)')} as s11, {mean('(x2 - m2) * (x2 - m2)')} as s22, {mean('(x1 - m1) * (x2 - m2)')} as s12, {mean('(x1 - m1) * (y - my)')} as s1y, {mean('(x2 - m2) * (y - my)')} as s2y, {reg} / sqrt({mean('(y - my) * (y - my)')}) as pen from tr join me using (window_id) group by 1),
be as (select *, ((s22 + pen) * s1y - s12 * s2y) / ((s11 + pen) * (s22 + pen) - s12 * s12) as b1, ((s11 + pen) * s2y - s12 * s1y) / ((s11 + pen) * (s22 + pen) - s12 * s12) as b2 from va),
pr as (select window_id, ticker, trade_date, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) as p from f join win on date_idx between tlo and thi join be using (window_id) where y is not null),
cs as (select window_id, avg(a) as ic_cs from (select window_id, trade_date, {corr('p', 'y')} as a from pr group by 1, 2) group by 1),
sh as (select *, (rank() over (partition by window_id order by p) + (count(*) over (partition by window_id, p) - 1) / 2.0) / count(*) over (partition by window_id) as share from pr),
mt as (select window_id, count(*) as n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2, sqrt(avg((y - p) * (y - p))) as rmse, {corr('p', 'y')} as ic, covar_samp(p, y) / var_pop(y) as slope, avg(case when share > 0.9 then y end) as top_decile, any_value(ic_cs) as ic_cs from sh join cs using (window_id) group by 1)"""


WALKED = {"linear": walk_sql(), "ridge": walk_sql(0.01)}

for _kind in ("linear", "ridge", "lasso", "logistic", "gbt", "forest"):

    def _wf(kind=_kind):
        return lambda spark, sf: L.metrics(L.MODELS[kind](month_panel(spark, sf), ["ret", "turnover"], windows(spark, sf))).select("window_id", "n", *[F.round(c, 4).alias(c) for c in ("r2", "rmse", "ic", "slope", "top_decile", "ic_cs")])

    query(f"{_kind}_walk_forward", f"with {WALKED[_kind]} select window_id, n, {', '.join(f'round({c}, 4) as {c}' for c in ('r2', 'rmse', 'ic', 'slope', 'top_decile', 'ic_cs'))} from mt" if _kind in WALKED else None)(_wf())


@query("weighted_walk_forward", f"with {walk_sql(weight='greatest(coalesce(cap, 0), 0)')} select window_id, n, round(ic, 4) as ic, round(r2, 4) as r2 from mt")
def weighted_walk_forward(spark, sf):
    return L.metrics(L.walk_forward(month_panel(spark, sf), ["ret", "turnover"], "linear", windows(spark, sf), weight="cap")).select("window_id", "n", F.round("ic", 4).alias("ic"), F.round("r2", 4).alias("r2"))


@query("feature_importance")
def feature_importance(spark, sf):
    return L.importances(month_panel(spark, sf), ["ret", "turnover"], "forest", windows(spark, sf)).withColumn("importance", F.round("importance", 6))


@query("sample_matrix", f"with f as (select ticker, trade_date, date_idx, ret as ret_0, lag(ret) over w as ret_1, lead(vwap, 2) over w / nullif(lead(vwap) over w, 0) - 1 as y0 from panel window w as (partition by ticker order by date_idx)) select ticker, trade_date, {r('ret_0')} as ret_0, {r('ret_1')} as ret_1, {r('y0 - avg(y0) over (partition by trade_date)')} as y from f")
def sample_matrix(spark, sf):
    return L.samples(month_panel(spark, sf), ["ret"], 2)[0].select("ticker", "trade_date", r6("ret_0").alias("ret_0"), r6("ret_1").alias("ret_1"), r6("y").alias("y"))


def graph_windows(spark, sf):
    return [(k, lo, hi) for k, lo, hi, _, _ in windows(spark, sf)]


for _method in ("complete", "filtered", "spectral", "node2vec", "sub2vec", "louvain", "pmfg_spectral", "pmfg_node2vec"):

    def _cluster(method=_method):
        return lambda spark, sf: G.clustered(month_panel(spark, sf), graph_windows(spark, sf), method, 5, 12)

    query(f"cluster_{_method}")(_cluster())


for _edges in ("mst", "pmfg"):

    def _graph(kind=_edges):
        return lambda spark, sf: G.window_graph(month_panel(spark, sf), graph_windows(spark, sf), kind, 12).withColumn("rho", r6("rho"))

    query(f"{_edges}_edges")(_graph())


@query("dyn_industry")
def dyn_industry(spark, sf):
    p = month_panel(spark, sf)
    labels = G.clustered(p, graph_windows(spark, sf), "complete", 5, 12)
    return G.dynamic_industry(p, labels, [(k, lo, hi) for k, _, _, lo, hi in windows(spark, sf)])


@query("dynamic_onehot")
def dynamic_onehot(spark, sf):
    return dyn_industry(spark, sf).groupBy("trade_date").pivot("label", [-1, 0, 1, 2, 3, 4]).agg(F.count(F.lit(1)))


@query("lag_of_labels", f"select ticker, trade_date, {r('last_value(case when date_idx % 3 = 0 then ret end ignore nulls) over (partition by ticker order by date_idx rows between unbounded preceding and current row)')} as held from panel")
def lag_of_labels(spark, sf):
    back = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return month_panel(spark, sf).select("ticker", "trade_date", r6(F.last(F.when(F.col("date_idx") % 3 == 0, F.col("ret")), ignorenulls=True).over(back)).alias("held"))
