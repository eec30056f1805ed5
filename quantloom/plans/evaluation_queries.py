"""Metrics of models, grids of holding, lead, lag and split tests, curves of signals, pools, sinks, and inputs of risk attribution."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import div, r6, rank_first
from ..operators import backtest as B
from ..operators import calendar as C
from ..operators import factors as X
from ..operators import masks as M
from ..operators import ml as L
from ..operators import regress as R
from ..operators.attribution import risk_inputs as inputs
from ..operators.evaluate import signal_curves as curves_of_signal
from ..sources.panel import month_panel
from ..sources.store import Store, kept_in
from .artifact_queries import FEATURES, FITTED, labelled, trained
from .backtest_queries import BENCH, FACTORED, HEAD, PATHS, RATE, SIGNALS, factored, port_sql, signals
from .model_queries import WLS, factor_series, styled
from .record_queries import side_sql
from .registry import corr, query, r

_PRED = f"{FITTED}, pr as (select cast(k as integer) as window_id, ticker, trade_date, y, my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2 as p from c join b using (k) where not is_train and y is not null)"
_CS = f"cs as (select window_id, avg(a) as ic_cs, avg(b) as sm_ic_cs from (select window_id, trade_date, {corr('p', 'y')} as a, {corr('p', 'rk')} as b from (select *, rank() over (partition by window_id, trade_date order by y) + (count(*) over (partition by window_id, trade_date, y) - 1) / 2.0 as rk from pr) group by 1, 2) group by 1)"


@query(
    "model_metrics",
    f"""{_PRED}, {_CS}, o as (select *, row_number() over (partition by window_id order by y, trade_date, ticker) as rk, (rank() over (partition by window_id order by p) + (count(*) over (partition by window_id, p) - 1) / 2.0) / count(*) over (partition by window_id) as share, (p > 0)::int as pc, (y > 0)::int as yc from pr),
m as (select window_id, count(*) as n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2, sqrt(avg((y - p) * (y - p))) as rmse, {corr('p', 'y')} as ic, {corr('p', 'rk')} as sm_ic, covar_samp(p, y) / var_pop(y) as slope, avg(case when share > 0.9 then y end) as top_decile, avg((pc = yc)::int) as accuracy, sum(pc * yc) / nullif(sum(pc), 0)::double as prec, sum(pc * yc) / nullif(sum(yc), 0)::double as rec from o group by 1)
select window_id, n, {r('r2')} as r2, {r('1 - (1 - r2) * (n - 1) / (n - 3)')} as adj_r2, {r('rmse')} as rmse, {r('ic')} as ic, {r('sm_ic')} as sm_ic, {r('ic_cs')} as ic_cs, {r('sm_ic_cs')} as sm_ic_cs, {r('slope')} as slope, {r('top_decile')} as top_decile, {r('accuracy')} as accuracy, {r('prec')} as "precision", {r('rec')} as recall, {r('2 * prec * rec / nullif(prec + rec, 0)')} as f1 from m join cs using (window_id)""",
)
def model_metrics(spark, sf):
    models, split = trained(spark, sf)
    got = L.full_metrics(models.predict(labelled(spark, sf), split, labels=True).withColumnRenamed("value", "prediction"), len(FEATURES))
    return got.select("window_id", "n", *[r6(c).alias(c) for c in got.columns if c not in ("window_id", "n")])


def held_sql(paths: str, shift: str) -> str:
    """CTE ``tot`` (grid, long, short): sums of the mean series of 0/1 signals held over ``paths`` paths, the factor moved by ``shift`` dates; ``grid`` has a column g."""
    return f"""s0 as (select g, ticker, trade_date, date_idx, y, {shift} as m from f cross join grid window w as (partition by g, ticker order by date_idx)),
s1 as (select *, case when m is not null then row_number() over (partition by g, trade_date order by m nulls last, ticker) end as rk, count(m) over (partition by g, trade_date) as n from s0),
s2 as (select *, case when n > 0 then coalesce((rk > n - {HEAD})::int::double, 0) end as top, case when n > 0 then coalesce((rk <= {HEAD})::int::double, 0) end as low from s1),
s3 as (select s2.*, path_id from s2 join (select g, cast(unnest(range(0, {paths})) as integer) as path_id from grid) using (g)),
s4 as (select *, {', '.join(f"coalesce(last_value(case when date_idx % ({paths}) = path_id then {a} end ignore nulls) over w, 0) as {b}" for a, b in (('top', 'lw'), ('low', 'sw')))} from s3 window w as (partition by g, path_id, ticker order by date_idx rows between unbounded preceding and current row)),
s5 as (select g, path_id, trade_date, sum(y * lw) / nullif(sum(lw), 0) as l, sum(y * sw) / nullif(sum(sw), 0) as s from s4 group by all),
s6 as (select g, trade_date, avg(l) as l, avg(s) as s from s5 group by all),
tot as (select g, coalesce(sum(l), 0) as l, coalesce(sum(s), 0) as s, coalesce(sum(l - s), 0) as ls from s6 group by 1)"""


_SUMS = f"{r('l')} as long_sum, {r('s')} as short_sum, {r('ls')} as long_short"


def sums(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in ("long_sum", "short_sum", "long_short")])


@query("decay_grid", f"with {FACTORED}, grid as (select unnest([1, 3]) as g), {held_sql('g', 'mom')} select cast(g as integer) as holding, {_SUMS} from tot")
def decay_grid(spark, sf):
    return sums(B.held_sums(factored(spark, sf), "mom", "y", HEAD, [(n, n, 0) for n in (1, 3)]), F.col("cell").alias("holding"))


_SHIFT = "case " + " ".join(f"when g = {g} then {'lead' if g < 0 else 'lag'}(mom, {abs(g)}) over w" for g in range(-2, 5)) + " end"


@query("lead_lag_grid", f"with {FACTORED}, grid as (select unnest(range(-2, 5)) as g), {held_sql(str(PATHS), _SHIFT)} select cast(g as integer) as lag_n, {_SUMS} from tot")
def lead_lag_grid(spark, sf):
    return sums(B.held_sums(factored(spark, sf), "mom", "y", HEAD, [(g, PATHS, g) for g in range(-2, 5)]), F.col("cell").alias("lag_n"))


SPLITS = {"cto": "open / nullif(preclose, 0) - 1", "otv": "(vwap - open) / nullif(preclose, 0)", "vtc": "(close - vwap) / nullif(preclose, 0)"}


@query("split_grid", "with f as (select *, vwap / nullif(lag(vwap, 3) over w, 0) - 1 as mom from panel window w as (partition by ticker order by date_idx)), grid as (select 0 as g), " + ", ".join(f"{k}_f as (select *, {e} as y from f)" for k, e in SPLITS.items()) + ", " + ", ".join(re.sub(r"\b(s[0-6]|tot)\b", rf"{k}_\1", held_sql("1", "mom").replace("from f cross", f"from {k}_f cross")) for k in SPLITS) + " " + " union all ".join(f"select '{k}' as part, {_SUMS} from {k}_tot" for k in SPLITS))
def split_grid(spark, sf):
    pre = F.col("preclose")
    p = factored(spark, sf).withColumns({"cto": div("open", pre) - 1, "otv": div(F.col("vwap") - F.col("open"), pre), "vtc": div(F.col("close") - F.col("vwap"), pre)})
    out = None
    for part in SPLITS:
        one = sums(B.held_sums(p, "mom", part, HEAD, [(0, 1, 0)]), F.lit(part).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out


def window_rows(spark, sf, **options):
    n = month_panel(spark, sf).select("date_idx").distinct().count()
    return spark.createDataFrame(list(C.walk_forward(n, 24, 12, 12, 1, **options)), "window_id int, lo int, hi int, test_lo int, test_hi int")


_K = "from (select unnest(range(0, 100)) as k) cross join (select count(*) as n from cal)"


@query("cal_expanding", f"select cast(k as integer) as window_id, 0 as lo, cast(k * 12 + 23 as integer) as hi, cast(k * 12 + 25 as integer) as test_lo, cast(least(k * 12 + 36, n - 1) as integer) as test_hi {_K} where k * 12 + 25 < n")
def cal_expanding(spark, sf):
    return window_rows(spark, sf, mode="expanding")


@query("cal_bisect", f"select cast(k as integer) as window_id, cast(k * 12 as integer) as lo, cast(k * 12 + 11 as integer) as hi, cast(k * 12 + 13 as integer) as test_lo, cast(k * 12 + 23 as integer) as test_hi {_K} where k * 12 + 24 <= n")
def cal_bisect(spark, sf):
    return window_rows(spark, sf, mode="bisect")


@query("windows_kept", f"select cast(k as integer) as window_id, cast(k * 12 as integer) as lo, cast(k * 12 + 23 as integer) as hi, cast(k * 12 + 25 as integer) as test_lo, cast(least(k * 12 + 36, n - 1) as integer) as test_hi {_K} where k * 12 + 25 < n")
def windows_kept(spark, sf):
    """The list of windows, written once and loaded."""
    store = Store(spark, kept_in(spark, sf))
    if not store.has("windows", name="rolling_24_12"):
        store.write("windows", window_rows(spark, sf), name="rolling_24_12")
    return store.read("windows", name="rolling_24_12").drop("name")


_SIG = f"{FACTORED}, {SIGNALS}, {BENCH}, {side_sql('long')}, {side_sql('short')}"


@query("signal_curves", f"with {_SIG}, c as (select trade_date, sum(coalesce(l.net, 0)) over t as long, sum(coalesce(s.net, 0)) over t as short from long_series l join short_series s using (trade_date) window t as (order by trade_date rows unbounded preceding)), e as (select last(long order by trade_date) >= last(short order by trade_date) as up from c), b as (select *, long - short as long_short, case when up then long else short end as best from c cross join e) select trade_date, {r('long')} as long, {r('short')} as short, {r('long_short')} as long_short, {r('best')} as best, {r('best - max(best) over (order by trade_date rows unbounded preceding)')} as drawdown from b")
def signal_curves(spark, sf):
    s = signals(spark, sf)
    got = curves_of_signal(*[B.over_paths(B.portfolio(s, f"{k}_w", "y", RATE)) for k in ("long", "short")])
    return got.select("trade_date", *[r6(c).alias(c) for c in got.columns if c != "trade_date"])


@query("path_annual", f"with {FACTORED}, {SIGNALS}, {port_sql('long_w')} select path_id, {r('252 * avg(net)')} as annual from port group by 1")
def path_annual(spark, sf):
    return B.portfolio(signals(spark, sf), "long_w", "y", RATE).groupBy("path_id").agg(r6(B.DAYS * F.avg("net")).alias("annual"))


def kept_factor(spark, sf):
    """Momentum written as a feature, and read again."""
    store = Store(spark, kept_in(spark, sf))
    if not store.has("feature", kind="factor", name="mom_3"):
        store.write("feature", factored(spark, sf).select("ticker", "trade_date", F.col("mom").alias("value")), kind="factor", name="mom_3")
    return store.read("feature", kind="factor", name="mom_3").select("ticker", "trade_date", "value")


@query("factor_in_pool", f"with {FACTORED} select ticker, trade_date, {r('mom')} as value from f where value is not null and region in (1, 3)")
def factor_in_pool(spark, sf):
    pool = M.members(M.index_weights(month_panel(spark, sf)), ["1", "3"])
    return M.restrict(kept_factor(spark, sf), pool).withColumn("value", r6("value"))


POOL = ("000001", "000002", "000005", "000008", "unknown")


@query("factor_in_list", f"with {FACTORED} select ticker, trade_date, {r('mom')} as value from f where ticker in ({', '.join(map(repr, POOL))})")
def factor_in_list(spark, sf):
    return M.restrict_to(kept_factor(spark, sf), POOL).withColumn("value", r6("value"))


@query("limit_flags", "select ticker, trade_date, case when high = low and preclose is not null then sign(close / preclose - 1) else 0 end::double as flag from panel")
def limit_flags(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", M.limit_flag().alias("flag"))


@query("industry_matrix", "select ticker, cls.class_code, (coalesce(cast(t.industry as varchar), '100000') = cls.class_code)::int as member from (select distinct ticker, case when industry % 7 = 0 then null else industry end as industry from panel) t cross join (select distinct class_code from (select coalesce(cast(case when industry % 7 = 0 then null else industry end as varchar), '100000') as class_code from panel) union select '100000') cls")
def industry_matrix(spark, sf):
    """Every seventh industry code counts as unknown."""
    p = month_panel(spark, sf).select("ticker", F.when(F.col("industry") % 7 != 0, F.col("industry")).alias("industry")).distinct()
    return R.membership(p, "industry")


@query("argsort_rank", f"with {FACTORED} select ticker, trade_date, case when mom is not null then row_number() over (partition by trade_date order by mom nulls last, ticker) - 1 end as rk from f")
def argsort_rank(spark, sf):
    return factored(spark, sf).select("ticker", "trade_date", (rank_first("mom") - 1).alias("rk"))


@query("holdings_kept", f"with {FACTORED}, {SIGNALS} select ticker, trade_date, long_w as w from sig where path_id = 1 and long_w > 0")
def holdings_kept(spark, sf):
    """The long holdings of every path, written; one path's read."""
    store = Store(spark, kept_in(spark, sf))
    if not store.has("signal", name="mom_long"):
        store.write("signal", signals(spark, sf).where("long_w > 0").select("path_id", "ticker", "trade_date", F.col("long_w").alias("w")), name="mom_long")
    return store.read("signal", name="mom_long", path_id=1).select("ticker", "trade_date", "w")


@query("held_names", f"with {FACTORED}, {SIGNALS}, n as (select path_id, ticker, trade_date, long_w / nullif(sum(long_w) over (partition by path_id, trade_date), 0) as w from sig) select path_id, ticker, trade_date, {r('w')} as w from n where w > 1e-6 and ticker not in ('000002', '000005')")
def held_names(spark, sf):
    """Names that are held, two of them blacklisted."""
    s = signals(spark, sf)
    share = s.select("path_id", "ticker", "trade_date", div("long_w", F.sum("long_w").over(Window.partitionBy("path_id", "trade_date"))).alias("w"))
    return M.held(share, ("000002", "000005")).withColumn("w", r6("w"))


@query("class_factors_kept", f"with o as (select *, (coalesce(ret, 0) + coalesce(turnover, 0)) / nullif((ret is not null)::int + (turnover is not null)::int, 0) as x from panel), k as (select ticker, trade_date, 'class' as name, (x - sum(x * cap) over d / nullif(sum(case when x is not null then cap end) over d, 0)) / nullif(stddev_samp(x) over d, 0) as value from o window d as (partition by trade_date) union all select ticker, trade_date, 'ret', ret from panel union all select ticker, trade_date, 'turnover', turnover from panel) select ticker, trade_date, name, {r('value')} as value from k")
def class_factors_kept(spark, sf):
    """Two factors and the class that they make, each a feature of its own."""
    store, p = Store(spark, kept_in(spark, sf)), month_panel(spark, sf)
    if not store.has("feature", kind="style", name="class"):
        for name in ("ret", "turnover"):
            store.write("feature", p.select("ticker", "trade_date", F.col(name).alias("value")), kind="style", name=name)
        store.write("feature", X.merged(p, ["ret", "turnover"]).select("ticker", "trade_date", "value"), kind="style", name="class")
    return store.read("feature", kind="style").select("ticker", "trade_date", "name", r6("value").alias("value"))


@query("risk_inputs", f"with {WLS}, u as (select ticker, trade_date, lead(s_size) over w as size_0, lead(s_mom) over w as mom_0 from styled window w as (partition by ticker order by date_idx)), ix as (select trade_date, region, sum(close * value) / nullif(sum(case when close is not null then value end), 0) as index_close from panel group by all), fr as (select trade_date, max(case when name = 's_size' then value end) as f_size, max(case when name = 's_mom' then value end) as f_mom from wls_f group by 1) select p.ticker, p.trade_date, {r('p.ret')} as ret, {r('size_0')} as s_size, {r('mom_0')} as s_mom, {r('100 * value / nullif(sum(value) over (partition by p.trade_date, p.region), 0)')} as weight, {r('index_close')} as index_close, {r('f_size')} as f_size, {r('f_mom')} as f_mom from panel p join u using (ticker, trade_date) left join ix on ix.trade_date = p.trade_date and ix.region = p.region left join fr on fr.trade_date = p.trade_date")
def risk_inputs(spark, sf):
    factors = factor_series(spark, sf).where("kind = 'factor'").groupBy("trade_date").pivot("name", ["s_size", "s_mom"]).agg(F.max("value")).withColumnsRenamed({"s_size": "f_size", "s_mom": "f_mom"})
    got = inputs(styled(spark, sf), ["s_size", "s_mom"], "region", factors)
    return got.select("ticker", "trade_date", *[r6(c).alias(c) for c in ("ret", "s_size", "s_mom", "weight", "index_close", "f_size", "f_mom")])
