"""Calendars, projections, masks and joins on the panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import by_date, by_ticker, bfill, div, lag, masked, r6
from ..operators import calendar as C
from ..operators import masks as M
from ..sources.panel import day_panel, month_panel, table
from .registry import query, r


def cal_of(spark, sf):
    return month_panel(spark, sf).select("trade_date", "date_idx").distinct()


@query("panel_month", f"select ticker, trade_date, date_idx, {r('open')} as open, {r('high')} as high, {r('low')} as low, {r('close')} as close, {r('vwap')} as vwap, {r('volume')} as volume, {r('value')} as value, {r('ret')} as ret from panel")
def panel_month(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", "date_idx", *[r6(c).alias(c) for c in ("open", "high", "low", "close", "vwap", "volume", "value", "ret")])


@query("panel_day", f"select ticker, trade_date, date_idx, {r('open')} as open, {r('close')} as close, {r('vwap')} as vwap, volume from day", day=True, month=False)
def panel_day(spark, sf):
    return day_panel(spark, sf).select("ticker", "trade_date", "date_idx", r6("open").alias("open"), r6("close").alias("close"), r6("vwap").alias("vwap"), "volume")


@query("src_universe", "select ticker, min(trade_date) as list_date, count(close) as n_bars from panel where close is not null group by ticker")
def src_universe(spark, sf):
    return month_panel(spark, sf).where("close is not null").groupBy("ticker").agg(F.min("trade_date").alias("list_date"), F.count("close").alias("n_bars"))


@query("src_industry", "select lpad(cast(s_suppkey as varchar), 6, '0') as con_code, cast(s_nationkey as varchar) as index_code, n_name as name from supplier join nation on s_nationkey = n_nationkey", month=False)
def src_industry(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("con_code"), F.col("s_nationkey").cast("string").alias("index_code"), F.col("n_name").alias("name"))


@query("src_index_weight", f"select cast(region as varchar) as index_code, ticker, trade_date, {r('100 * value / sum(value) over (partition by trade_date, region)')} as weight from panel where value is not null")
def src_index_weight(spark, sf):
    return M.index_weights(month_panel(spark, sf)).withColumn("weight", r6("weight"))


@query("src_signal_scaled", f"select ticker, trade_date, {r('volume / nullif(sum(volume) over (partition by trade_date), 0)')} as weight from panel where region in (0, 1)")
def src_signal_scaled(spark, sf):
    return month_panel(spark, sf).where("region in (0, 1)").select("ticker", "trade_date", r6(div("volume", F.sum("volume").over(by_date()))).alias("weight"))


@query("cal_range", "select trade_date, date_idx from cal where trade_date between date '1996-03-15' and date '1997-02-10'")
def cal_range(spark, sf):
    return cal_of(spark, sf).where("trade_date between date '1996-03-15' and date '1997-02-10'")


@query("cal_next_prev", "select trade_date, date_idx, lead(trade_date) over (order by trade_date) as next_date, lag(trade_date) over (order by trade_date) as prev_date from cal")
def cal_next_prev(spark, sf):
    return C.neighbours(cal_of(spark, sf))


@query("cal_nth_prev", "select c.trade_date, c.date_idx, p.trade_date as nth_date from cal c join cal p on p.date_idx = greatest(0, least((select max(date_idx) from cal), c.date_idx - 5))")
def cal_nth_prev(spark, sf):
    return C.nth_previous(cal_of(spark, sf), 5).select("trade_date", "date_idx", "nth_date")


@query("cal_paths", "select trade_date, date_idx, date_idx % 5 as path_id from cal")
def cal_paths(spark, sf):
    return C.paths(cal_of(spark, sf), 5)


@query("cal_week_paths", """with days as (select distinct cast(o_orderdate as date) as trade_date from orders), d as (select trade_date, cast(date_trunc('week', trade_date) as date) as week, isodow(trade_date) as dow from days where isodow(trade_date) <= 5),
hit as (select w.week, p.path_id, max(case when d.dow <= p.path_id then d.trade_date end) as own from (select distinct week from d) w cross join (select cast(unnest(range(1, 6)) as integer) as path_id) p left join d on d.week = w.week group by all)
select week, path_id, last_value(own ignore nulls) over (partition by path_id order by week rows between unbounded preceding and current row) as trade_date from hit""", month=False)
def cal_week_paths(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return C.week_paths(days).select("week", "path_id", "trade_date")


@query("cal_walk_forward", "select cast(k as integer) as window_id, cast(k * 12 as integer) as lo, cast(k * 12 + 23 as integer) as hi, cast(k * 12 + 25 as integer) as test_lo, cast(least(k * 12 + 36, n - 1) as integer) as test_hi from (select unnest(range(0, 100)) as k) cross join (select count(*) as n from cal) where k * 12 + 25 < n")
def cal_walk_forward(spark, sf):
    n = cal_of(spark, sf).count()
    return spark.createDataFrame(list(C.walk_forward(n, 24, 12, 12, 1)), "window_id int, lo int, hi int, test_lo int, test_hi int")


@query("cal_intersect", "select trade_date from (select trade_date from cal intersect select distinct cast(date_trunc('month', o_orderdate) as date) from orders) order by trade_date offset 3")
def cal_intersect(spark, sf):
    months = table(spark, sf, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("trade_date"))
    both = cal_of(spark, sf).select("trade_date").intersect(months)
    return both.withColumn("n", F.row_number().over(C.in_order())).where("n > 3").drop("n")


@query("asof_prev", "with d as (select distinct cast(ts as date) - interval 8000 day as x from events) select cast(x as date) as d, max(case when trade_date < x then trade_date end) as prev_date, min(case when trade_date > x then trade_date end) as next_date from d cross join cal group by all")
def asof_prev(spark, sf):
    dates = table(spark, sf, "events").select(F.date_sub(F.to_date("ts"), 8000).alias("d")).distinct()
    return C.asof_previous(dates, cal_of(spark, sf))


@query("missing_dates", f"select c.trade_date, {r('v')} as v from cal c left join (select trade_date, sum(value) as v from panel where date_idx % 3 <> 1 group by 1) s on s.trade_date = c.trade_date")
def missing_dates(spark, sf):
    s = month_panel(spark, sf).where("date_idx % 3 <> 1").groupBy("trade_date").agg(r6(F.sum("value")).alias("v"))
    return C.with_missing_dates(s, cal_of(spark, sf))


@query("ret_family", f"""select ticker, trade_date, {r('close / nullif(open, 0) - 1')} as o2c, {r('lead(open) over w / nullif(open, 0) - 1')} as o2next_o, {r('lead(open) over w / nullif(close, 0) - 1')} as c2next_o, {r('ret')} as c2c
from panel window w as (partition by ticker order by date_idx)""")
def ret_family(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", r6(div("close", "open") - 1).alias("o2c"), r6(div(lag("open", -1), "open") - 1).alias("o2next_o"), r6(div(lag("open", -1), "close") - 1).alias("c2next_o"), r6("ret").alias("c2c"))


@query("fwd_ret", f"select ticker, trade_date, {r('lead(vwap, 2) over w / nullif(lead(vwap) over w, 0) - 1')} as fwd_1, {r('lead(vwap, 4) over w / nullif(lead(vwap) over w, 0) - 1')} as fwd_3 from panel window w as (partition by ticker order by date_idx)")
def fwd_ret(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", r6(div(lag("vwap", -2), lag("vwap", -1)) - 1).alias("fwd_1"), r6(div(lag("vwap", -4), lag("vwap", -1)) - 1).alias("fwd_3"))


@query("fwd_decay_ret", "select ticker, trade_date, " + ", ".join(f"{r(f'lead(vwap, {i + 2}) over w / nullif(lead(vwap) over w, 0) - 1')} as decay_{i}" for i in range(4)) + " from panel window w as (partition by ticker order by date_idx)")
def fwd_decay_ret(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", *[r6(div(lag("vwap", -(i + 2)), lag("vwap", -1)) - 1).alias(f"decay_{i}") for i in range(4)])


@query("split_ret", f"select ticker, trade_date, {r('open / preclose - 1')} as cto, {r('(vwap - open) / preclose')} as otv, {r('(close - vwap) / preclose')} as vtc, {r('(lead(open) over w - close) / preclose')} as cto1 from panel window w as (partition by ticker order by date_idx)")
def split_ret(spark, sf):
    p = F.col("preclose")
    return month_panel(spark, sf).select("ticker", "trade_date", r6(F.col("open") / p - 1).alias("cto"), r6((F.col("vwap") - F.col("open")) / p).alias("otv"), r6((F.col("close") - F.col("vwap")) / p).alias("vtc"), r6((lag("open", -1) - F.col("close")) / p).alias("cto1"))


LABEL = "with l as (select *, lead(vwap, 2) over w / nullif(lead(vwap) over w, 0) - 1 as y0 from panel window w as (partition by ticker order by date_idx)), lab as (select *, y0 - avg(y0) over (partition by trade_date) as y from l)"


def labelled(spark, sf):
    p = month_panel(spark, sf).withColumn("y0", div(lag("vwap", -2), lag("vwap", -1)) - 1)
    return p.withColumn("y", F.col("y0") - F.avg("y0").over(by_date()))


@query("label_demeaned", LABEL + f" select ticker, trade_date, {r('y')} as y from lab")
def label_demeaned(spark, sf):
    return labelled(spark, sf).select("ticker", "trade_date", r6("y").alias("y"))


@query("label_class", LABEL + " select ticker, trade_date, case when y is not null then case when y > 1e-9 then 1.0 else 0.0 end end::double as y_class from lab")
def label_class(spark, sf):
    return labelled(spark, sf).select("ticker", "trade_date", F.when(F.col("y").isNotNull(), (F.col("y") > 1e-9).cast("double")).alias("y_class"))


@query("label_fuzz", LABEL + f" select ticker, trade_date, {r('case when abs(y) >= 0.01 then y end')} as y_zero, {r('case when abs(y - m) <= 2 * s then y end')} as y_large from lab cross join (select avg(y) as m, stddev_samp(y) as s from lab)")
def label_fuzz(spark, sf):
    p = labelled(spark, sf)
    stats = p.agg(F.avg("y").alias("m"), F.stddev("y").alias("s"))
    return p.crossJoin(F.broadcast(stats)).select("ticker", "trade_date", r6(F.when(F.abs("y") >= 0.01, F.col("y"))).alias("y_zero"), r6(F.when(F.abs(F.col("y") - F.col("m")) <= 2 * F.col("s"), F.col("y"))).alias("y_large"))


@query("mask_addback", f"select ticker, trade_date, {r('case when open is not null then ret end')} as ret, {r('ret / nullif(turnover, 0)')} as ratio from panel")
def mask_addback(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", r6(masked("ret", "open")).alias("ret"), r6(div("ret", "turnover")).alias("ratio"))


@query("plate_code", "select ticker, trade_date, case when starts_with(ticker, '00000') then 4 when starts_with(ticker, '00001') then 5 when region = 0 then 0 when region = 1 then 1 when region = 2 then 2 when region = 3 then 3 else 6 end as plate from panel")
def plate_code(spark, sf):
    t = F.col("ticker")
    plate = F.when(t.startswith("00000"), 4).when(t.startswith("00001"), 5).when(F.col("region") <= 3, F.col("region")).otherwise(6)
    return month_panel(spark, sf).select("ticker", "trade_date", plate.cast("int").alias("plate"))


@query("industry_onehot", "select lpad(cast(s_suppkey as varchar), 6, '0') as ticker, " + ", ".join(f"cast(n_regionkey = {i} as integer) as ind_{i + 1}" for i in range(5)) + " from supplier join nation on s_nationkey = n_nationkey", month=False)
def industry_onehot(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ticker"), *[(F.col("n_regionkey") == i).cast("int").alias(f"ind_{i + 1}") for i in range(5)])


@query("scalar_functions", f"select ticker, trade_date, {r('ln(value)')} as ln_v, {r('log10(value)')} as log_v, {r('pow(vwap / 1000, 3)')} as cube, {r('sqrt(volume)')} as root, {r('abs(ret)')} as size, lpad(cast(cast(ticker as integer) as varchar), 6, '0') as padded, substr(ticker, 1, 3) as prefix, strftime(trade_date, '%Y%m%d') as ymd from panel where value is not null")
def scalar_functions(spark, sf):
    return month_panel(spark, sf).where("value is not null").select("ticker", "trade_date", r6(F.ln("value")).alias("ln_v"), r6(F.log10("value")).alias("log_v"), r6(F.pow(F.col("vwap") / 1000, 3)).alias("cube"), r6(F.sqrt("volume")).alias("root"), r6(F.abs("ret")).alias("size"), F.lpad(F.col("ticker").cast("int").cast("string"), 6, "0").alias("padded"), F.substring("ticker", 1, 3).alias("prefix"), F.date_format("trade_date", "yyyyMMdd").alias("ymd"))


@query("wide_long", f"select ticker, trade_date, field, {r('v')} as v from (unpivot (select ticker, trade_date, open, close, vwap from panel where open is not null) on open, close, vwap into name field value v)")
def wide_long(spark, sf):
    p = month_panel(spark, sf).where("open is not null").select("ticker", "trade_date", "open", "close", "vwap")
    return p.unpivot(["ticker", "trade_date"], ["open", "close", "vwap"], "field", "v").withColumn("v", r6("v"))


@query("lag_features", "select ticker, trade_date, " + ", ".join(f"{r(f'lag(ret, {k}) over w')} as ret_{k}" for k in range(4)) + " from panel window w as (partition by ticker order by date_idx)")
def lag_features(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", *[r6(lag("ret", k)).alias(f"ret_{k}") for k in range(4)])


@query("long_short_split", f"select ticker, trade_date, {r('case when ret is not null then greatest(ret, 0) end')} as long_w, {r('case when ret is not null then -least(ret, 0) end')} as short_w from panel")
def long_short_split(spark, sf):
    x = F.col("ret")
    return month_panel(spark, sf).select("ticker", "trade_date", r6(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))).alias("long_w"), r6(F.when(x.isNotNull(), -F.least(x, F.lit(0.0)))).alias("short_w"))


@query("holding_weights", f"select ticker, trade_date, {r('coalesce(volume * close, 0) / nullif(sum(volume * close) over (partition by trade_date), 0)')} as w_vol, {r('coalesce(value, 0) / nullif(sum(value) over (partition by trade_date), 0)')} as w_val from panel")
def holding_weights(spark, sf):
    v = F.col("volume") * F.col("close")
    return month_panel(spark, sf).select("ticker", "trade_date", r6(div(F.coalesce(v, F.lit(0.0)), F.sum(v).over(by_date()))).alias("w_vol"), r6(div(F.coalesce("value", F.lit(0.0)), F.sum("value").over(by_date()))).alias("w_val"))


@query("index_mask", "select distinct ticker, trade_date from panel where value is not null and region in (1, 3)")
def index_mask(spark, sf):
    return M.members(M.index_weights(month_panel(spark, sf)), ["1", "3"])


@query("listed_filter", "select ticker, trade_date, date_idx > min(case when close is not null then date_idx end) over (partition by ticker) + 6 as listed from panel")
def listed_filter(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", M.listed(6).alias("listed"))


GAPS = "sum(case when close is null then 1 else 0 end) over (partition by ticker order by date_idx rows between 4 preceding and current row)"


@query("suspend_filter", f"select ticker, trade_date, {GAPS} = 0 and date_idx >= 4 as strict, {GAPS} = 0 as growing from day", day=True, month=False)
def suspend_filter(spark, sf):
    return day_panel(spark, sf).select("ticker", "trade_date", M.unsuspended(5).alias("strict"), M.unsuspended(5, True).alias("growing"))


@query("tradable", "select ticker, trade_date, coalesce(open is not null and preclose * 1.1 - open > 1e-6, false) as up, coalesce(open is not null and open - preclose * 0.9 > 1e-6, false) as down, coalesce(close <= preclose * 1.1 - 0.01, false) as overnight, case when high = low and preclose is not null then sign(close / preclose - 1) else 0 end::double as flag from panel")
def tradable(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", M.buyable().alias("up"), M.sellable().alias("down"), M.overnight().alias("overnight"), M.limit_flag().alias("flag"))


@query("close_limits", "select ticker, trade_date, coalesce(close / preclose - 1 >= case when starts_with(ticker, '00000') then 0.2 else 0.1 end - 0.001, false) as up, coalesce(close / preclose - 1 <= -(case when starts_with(ticker, '00000') then 0.2 else 0.1 end - 0.001), false) as down from panel")
def close_limits(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", M.close_at_limit(True).alias("up"), M.close_at_limit(False).alias("down"))


FEASIBLE = """with f as (select *, coalesce(open is not null and preclose * 1.1 - open > 1e-6, false) as can_buy, coalesce(open is not null and open - preclose * 0.9 > 1e-6, false) as can_sell,
date_idx > min(case when close is not null then date_idx end) over (partition by ticker) + 3 as is_listed, sum(case when close is null then 1 else 0 end) over (partition by ticker order by date_idx rows between 4 preceding and current row) = 0 and date_idx >= 4 as is_open from panel)"""


@query("feasible_lead", FEASIBLE + " select ticker, trade_date, lead(can_buy and is_listed and is_open) over (partition by ticker order by date_idx) as up, can_sell and is_listed as down from f")
def feasible_lead(spark, sf):
    up, down = M.feasible(3, 5)
    return month_panel(spark, sf).select("ticker", "trade_date", up.alias("up"), down.alias("down"))


@query("bfill_price", FEASIBLE + f" select ticker, trade_date, {r('case when open is not null then first_value(case when can_sell then open end ignore nulls) over (partition by ticker order by date_idx rows between current row and unbounded following) end')} as price from f")
def bfill_price(spark, sf):
    return month_panel(spark, sf).select("ticker", "trade_date", r6(M.next_feasible_price()).alias("price"))


@query("ever_member", "select distinct ticker from panel where value is not null and region = 2 and date_idx between 10 and 40")
def ever_member(spark, sf):
    return month_panel(spark, sf).where("value is not null and region = 2 and date_idx between 10 and 40").select("ticker").distinct()


@query("anti_nonmember", "select distinct ticker from panel where ticker not in (select ticker from panel where value is not null and region = 2)")
def anti_nonmember(spark, sf):
    p = month_panel(spark, sf)
    return p.select("ticker").distinct().join(p.where("value is not null and region = 2"), "ticker", "left_anti")


@query("sparse_tickers", f"select ticker, {r('avg(case when close is null then 1.0 else 0.0 end)')} as gap from day group by ticker having avg(case when close is null then 1.0 else 0.0 end) > 0.1", day=True, month=False)
def sparse_tickers(spark, sf):
    gap = F.avg(F.col("close").isNull().cast("double"))
    return day_panel(spark, sf).groupBy("ticker").agg(r6(gap).alias("gap"), gap.alias("g")).where("g > 0.1").drop("g")


@query("spine_full_outer", f"select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.trade_date, b.trade_date) as trade_date, {r('a.value * b.volume')} as prod from (select * from panel where date_idx % 2 = 0) a full join (select * from panel where date_idx % 3 = 0) b on a.ticker = b.ticker and a.trade_date = b.trade_date")
def spine_full_outer(spark, sf):
    p = month_panel(spark, sf)
    a, b = p.where("date_idx % 2 = 0").select("ticker", "trade_date", "value"), p.where("date_idx % 3 = 0").select("ticker", "trade_date", "volume")
    return a.join(b, ["ticker", "trade_date"], "full").select("ticker", "trade_date", r6(F.col("value") * F.col("volume")).alias("prod"))


@query("range_join_windows", "select cast(k as integer) as window_id, ticker, count(ret) as n from (select unnest(range(0, 5)) as k) join panel on date_idx between k * 12 and k * 12 + 23 group by all")
def range_join_windows(spark, sf):
    w = spark.createDataFrame([(k, 12 * k, 12 * k + 23) for k in range(5)], "window_id int, lo int, hi int")
    p = month_panel(spark, sf)
    return p.join(F.broadcast(w), F.col("date_idx").between(F.col("lo"), F.col("hi"))).groupBy("window_id", "ticker").agg(F.count("ret").alias("n"))


@query("ffill_bfill", f"select ticker, trade_date, {r('last_value(close ignore nulls) over (partition by ticker order by date_idx rows between unbounded preceding and current row)')} as ff, {r('first_value(close ignore nulls) over (partition by ticker order by date_idx rows between current row and unbounded following)')} as bf from day", day=True, month=False)
def ffill_bfill(spark, sf):
    from ..functions.expr import ffill

    return day_panel(spark, sf).select("ticker", "trade_date", r6(ffill("close")).alias("ff"), r6(bfill("close")).alias("bf"))


@query("running", f"select ticker, trade_date, {r('sum(ret) over w')} as cum, {r('max(close) over w')} as high_so_far from panel window w as (partition by ticker order by date_idx rows between unbounded preceding and current row)")
def running(spark, sf):
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return month_panel(spark, sf).select("ticker", "trade_date", r6(F.sum("ret").over(w)).alias("cum"), r6(F.max("close").over(w)).alias("high_so_far"))


@query("src_names", "select lpad(cast(s_suppkey as varchar), 6, '0') as ticker, s_name as name from supplier", month=False)
def src_names(spark, sf):
    return table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ticker"), F.col("s_name").alias("name"))


@query("adjusted_price", f"select ticker, trade_date, {r('close * adj')} as close, {r('vwap * adj')} as vwap, {r('close * adj / nullif(lag(close * adj) over (partition by ticker order by date_idx), 0) - 1')} as ret from (select *, 1 + 0.002 * date_idx as adj from panel)")
def adjusted_price(spark, sf):
    p = month_panel(spark, sf).withColumn("adj", 1 + 0.002 * F.col("date_idx"))
    p = p.withColumns({"close": F.col("close") * F.col("adj"), "vwap": F.col("vwap") * F.col("adj")})
    return p.select("ticker", "trade_date", r6("close").alias("close"), r6("vwap").alias("vwap"), r6(div("close", lag("close")) - 1).alias("ret"))


INDEX = "ix as (select region, trade_date, date_idx, " + ", ".join(f"sum({c} * cap) / nullif(sum(case when {c} is not null then cap end), 0) as {c}" for c in ("open", "close", "vwap")) + " from panel group by all)"


@query("index_ret", f"with {INDEX} select cast(region as varchar) as index_code, trade_date, {r('close / nullif(lag(close) over w, 0) - 1')} as c2c, {r('lead(open) over w / nullif(open, 0) - 1')} as o2next_o, {r('lead(vwap) over w / nullif(vwap, 0) - 1')} as v2next_v from ix window w as (partition by region order by date_idx)")
def index_ret(spark, sf):
    from ..functions.expr import weighted_mean

    ix = month_panel(spark, sf).groupBy("region", "trade_date", "date_idx").agg(*[weighted_mean(c, "cap").alias(c) for c in ("open", "close", "vwap")])
    w = Window.partitionBy("region").orderBy("date_idx")
    ahead = lambda c: r6(div(F.lead(c).over(w), c) - 1)
    return ix.select(F.col("region").cast("string").alias("index_code"), "trade_date", r6(div("close", F.lag("close").over(w)) - 1).alias("c2c"), ahead("open").alias("o2next_o"), ahead("vwap").alias("v2next_v"))


@query("trim_range", "select ticker, trade_date from panel where date_idx between 12 and (select max(date_idx) from panel) - 5")
def trim_range(spark, sf):
    return C.trimmed(month_panel(spark, sf), cal_of(spark, sf), 12, 5).select("ticker", "trade_date")


@query("weights_filled", f"with s as (select *, value / sum(value) over (partition by trade_date) as w from panel where value is not null and date_idx % 4 <> 3), g as (select p.ticker, p.trade_date, p.date_idx, case when p.date_idx % 4 <> 3 then coalesce(s.w, 0) end as known from panel p left join s on s.ticker = p.ticker and s.trade_date = p.trade_date) select ticker, trade_date, {r('last_value(known ignore nulls) over (partition by ticker order by date_idx rows between unbounded preceding and current row)')} as w from g")
def weights_filled(spark, sf):
    p = month_panel(spark, sf)
    w = p.where("value is not null and date_idx % 4 <> 3").select("ticker", "trade_date", div("value", F.sum("value").over(by_date())).alias("w"))
    return C.filled_weights(w, cal_of(spark, sf)).select("ticker", "trade_date", r6("w").alias("w"))
