"""Factor and signal backtests: information coefficients, signals, groups, costs and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, corr, div, lag, rank_avg, rank_first, rows, with_date

DAYS = 252


def forward(n: int = 1, price: str = "vwap") -> Column:
    """Return from the next date's price over n dates."""
    return div(lag(price, -(n + 1)), lag(price, -1)) - 1


def ic(panel: DataFrame, factor: str, ret: str) -> DataFrame:
    return panel.groupBy("trade_date").agg(corr(factor, ret).alias("ic"))


def rank_ic(panel: DataFrame, factor: str, ret: str) -> DataFrame:
    """Correlation of average ranks, each taken over its own full cross-section."""
    ranked = panel.withColumns({"rf": rank_avg(factor, True), "rr": rank_avg(ret, True)})
    return ranked.groupBy("trade_date").agg(corr("rf", "rr").alias("ic"))


def ic_stats(series: DataFrame, x: str = "ic") -> DataFrame:
    v = F.col(x)
    up, down = F.when(v > 0, v), F.when(v < 0, v)
    n = F.count(v)
    return series.agg(
        F.avg(v).alias("mean"), F.avg(up).alias("mean_pos"), F.avg(down).alias("mean_neg"), F.stddev_pop(v).alias("std"), F.stddev_pop(up).alias("std_pos"), F.stddev_pop(down).alias("std_neg"),
        div(F.count(up), n).alias("pos_ratio"), div(F.count(down), n).alias("neg_ratio"), div(F.count(F.when(F.abs(v) > 0.02, v)), n).alias("sig_ratio"), div(F.avg(v), F.stddev_pop(v)).alias("ir"),
    )


def ic_decay(panel: DataFrame, factor: str, ret: str, length: int) -> DataFrame:
    """Mean correlation with the sum of the returns 2..i+1 dates ahead, for each i; null for i = 0."""
    ahead = panel
    for i in range(1, length):
        w = by_ticker().rowsBetween(2, i + 1)
        ahead = ahead.withColumn(f"s{i}", F.when(F.count(ret).over(w) == i, F.sum(ret).over(w)))
    per_date = ahead.groupBy("trade_date").agg(*[corr(factor, f"s{i}").alias(f"c{i}") for i in range(1, length)])
    wide = per_date.agg(F.lit(None).cast("double").alias("c0"), *[F.avg(f"c{i}").alias(f"c{i}") for i in range(1, length)])
    return wide.unpivot([], [f"c{i}" for i in range(length)], "i", "ic").select(F.substring("i", 2, 9).cast("int").alias("horizon"), "ic")


def top_bottom(panel: DataFrame, factor: str, head: int, n_paths: int = 1, last: bool = True) -> DataFrame:
    """long_w and short_w (0/1) of every path: the highest and lowest ``head`` names on the path's dates, held until its next one.

    Only the names at both ends are moved; the panel's rows stay with their ticker.
    """
    if last:
        end = F.broadcast(panel.agg(F.max("date_idx").alias("last_idx")))  # one row
        ranked = panel.crossJoin(end).withColumn("f", F.when(F.col("date_idx") < F.col("last_idx"), F.col(factor))).drop("last_idx")
    else:
        ranked = panel.withColumn("f", F.col(factor))
    day, cells = Window.partitionBy("trade_date"), ranked.where("f is not null").select("trade_date", "ticker", "f")
    ends = {"top": day.orderBy(F.desc("f"), F.desc("ticker")), "low": day.orderBy("f", "ticker")}
    marked = [cells.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= head).select("trade_date", "ticker", F.lit(k).alias("end")) for k, w in ends.items()]
    marks = marked[0].unionByName(marked[1]).groupBy(F.col("trade_date").alias("of_date"), F.col("ticker").alias("of_ticker")).agg(*[F.max((F.col("end") == k).cast("double")).alias(f"is_{k}") for k in ends])
    ranked = with_date(ranked, n=F.count("f")).join(F.broadcast(marks), (F.col("trade_date") == F.col("of_date")) & (F.col("ticker") == F.col("of_ticker")), "left")  # both ends of each date
    ranked = ranked.withColumns({k: F.when(F.col("n") > 0, F.coalesce(f"is_{k}", F.lit(0.0))) for k in ends}).drop("of_date", "of_ticker", *[f"is_{k}" for k in ends])
    paths = ranked.withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    own = F.col("date_idx") % n_paths == F.col("path_id")
    back = Window.partitionBy("path_id", "ticker").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    held = {k: F.coalesce(F.last(F.when(own, F.col(c)), ignorenulls=True).over(back), F.lit(0.0)) for k, c in (("long_w", "top"), ("short_w", "low"))}
    return paths.withColumns(held)


def held_sums(panel: DataFrame, factor: str, ret: str, head: int, grid: list[tuple[int, int, int]]) -> DataFrame:
    """cell, long_sum, short_sum, long_short of a grid of (cell, paths, lag): what both sides and their difference earn in all, before cost.

    A cell's factor is that of ``lag`` dates before, of later dates if it is negative, and its signals are held over ``paths`` paths.
    All cells share one pass: the panel is copied once for each.
    """
    cells = panel.sparkSession.createDataFrame(grid, "cell int, paths int, moved int")
    p = panel.select("ticker", "trade_date", "date_idx", factor, ret).crossJoin(F.broadcast(cells))  # a row for each cell
    own = Window.partitionBy("cell", "ticker").orderBy("date_idx")
    moved = F.coalesce(*[F.when(F.col("moved") == k, (F.lag(factor, k) if k >= 0 else F.lead(factor, -k)).over(own)) for k in sorted({m for _, _, m in grid})])
    day = Window.partitionBy("cell", "trade_date")
    p = p.withColumn("m", moved)
    p = p.withColumns({"n": F.count("m").over(day), "rk": F.when(F.col("m").isNotNull(), F.row_number().over(day.orderBy(F.asc_nulls_last("m"), "ticker")))})
    p = p.withColumns({"top": F.when(F.col("n") > 0, F.coalesce(F.col("rk") > F.col("n") - head, F.lit(False)).cast("double")), "low": F.when(F.col("n") > 0, F.coalesce(F.col("rk") <= head, F.lit(False)).cast("double"))})
    p = p.withColumn("path_id", F.explode(F.sequence(F.lit(0), F.col("paths") - 1)))
    kept = F.col("date_idx") % F.col("paths") == F.col("path_id")
    back = Window.partitionBy("cell", "path_id", "ticker").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({w: F.coalesce(F.last(F.when(kept, F.col(c)), ignorenulls=True).over(back), F.lit(0.0)) for w, c in (("l", "top"), ("s", "low"))})
    paths = p.groupBy("cell", "path_id", "trade_date").agg(*[div(F.sum(F.col(ret) * F.col(w)), F.sum(w)).alias(w) for w in ("l", "s")])
    dates = paths.groupBy("cell", "trade_date").agg(F.avg("l").alias("l"), F.avg("s").alias("s"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return dates.groupBy("cell").agg(total(F.col("l")).alias("long_sum"), total(F.col("s")).alias("short_sum"), total(F.col("l") - F.col("s")).alias("long_short"))


def groups(panel: DataFrame, factor: str, n: int) -> DataFrame:
    """Quantile groups by rank; names whose rank is a bound belong to both groups."""
    ranked = panel.withColumn("rk", rank_first(factor)).withColumn("width", F.max("rk").over(Window.partitionBy("trade_date")) / F.lit(float(n)))
    return ranked.where("rk is not null").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where("rk between grp * width and (grp + 1) * width")


def costed(signals: DataFrame, w: str, rate: float, key: tuple[str, ...] = ("path_id", "ticker")) -> DataFrame:
    """With old (the previous weight) and cost per cell."""
    over = Window.partitionBy(*key).orderBy("date_idx")
    return signals.withColumn("old", F.lag(w).over(over)).withColumn("cost", F.abs(rate * (F.col("old") - F.col(w)) / 2))


def portfolio(signals: DataFrame, w: str, ret: str, rate: float = 0.0, by: tuple[str, ...] = ("path_id", "trade_date", "date_idx")) -> DataFrame:
    """Per path and date: gross and net return, cost and turnover. A missing return drops the name's cost too; on a first date, where no cost is known, net is 0."""
    c = costed(signals, w, rate)
    held = F.sum(w)
    net = F.sum(F.when(F.col(ret).isNotNull() & F.col("cost").isNotNull(), F.col(ret) * F.col(w) - F.col("cost")))
    total = Window.partitionBy(*by)
    share = F.coalesce(div(w, F.sum(w).over(total)), F.lit(0.0))
    c = c.withColumn("share", share)
    c = c.withColumn("moved", F.abs(F.col("share") - F.lag("share").over(Window.partitionBy("path_id", "ticker").orderBy("date_idx"))))
    return c.groupBy(*by).agg(
        div(F.sum(F.col(ret) * F.col(w)), held).alias("gross"), div(F.coalesce(net, F.lit(0.0)), held).alias("net"), div(F.coalesce(F.sum("cost"), F.lit(0.0)), held).alias("cost"), F.sum("moved").alias("turnover")
    )


def over_paths(series: DataFrame) -> DataFrame:
    """Means over the paths of each date; turnover over the paths that traded."""
    return series.groupBy("trade_date", "date_idx").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.avg("cost").alias("cost"), F.avg(F.when(F.col("turnover") != 0, F.col("turnover"))).alias("turnover"))


def benchmark(panel: DataFrame, ret: str, weight: str | None = "cap") -> DataFrame:
    from ..functions.expr import weighted_mean

    return panel.groupBy("trade_date").agg((weighted_mean(ret, weight) if weight else F.avg(ret)).alias("bench"))


def drawdown(x: str, by: tuple[str, ...] = ()) -> Column:
    """Running sum less its highest value so far."""
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(w)


def performance(series: DataFrame, ret: str = "net", bench: str = "bench") -> DataFrame:
    """Per calendar year and for 'sum': alpha return, Sharpe and drawdown, beta, return, drawdown, turnover and cost."""
    s = series.withColumn("alpha", F.col(ret) - F.col(bench)).withColumn("year", F.explode(F.array(F.year("trade_date").cast("string"), F.lit("sum"))))
    by = Window.partitionBy("year").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"cum": F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(by), "acum": F.sum(F.coalesce(F.col("alpha"), F.lit(0.0))).over(by)})
    s = s.withColumns({"dd": F.col("cum") - F.max("cum").over(by), "add": F.col("acum") - F.max("acum").over(by)})
    both = F.col(ret).isNotNull() & F.col(bench).isNotNull()
    a, b = F.when(both, F.col(ret)), F.when(both, F.col(bench))
    return s.groupBy("year").agg(
        (100 * F.sum("alpha")).alias("alpha_rtn"), (div(F.avg("alpha"), F.stddev("alpha")) * F.sqrt(F.lit(float(DAYS)))).alias("alpha_sharpe"), (100 * F.min("add")).alias("alpha_drawdown"),
        div(F.covar_samp(a, b), F.var_samp(b)).alias("beta"), (100 * F.sum(ret)).alias("rtn"), (100 * F.min("dd")).alias("drawdown"), F.avg("turnover").alias("turnover"), (100 * F.sum("cost")).alias("cost"),
    )


def longest_run(series: DataFrame, x: str) -> DataFrame:
    """Length of the longest run of positive values."""
    w = Window.orderBy("trade_date")
    s = series.withColumn("up", F.coalesce(F.col(x) > 0, F.lit(False)))
    s = s.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("up").orderBy("trade_date")))
    return s.where("up").groupBy("island").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def rolling_mean(x: str, n: int) -> Column:
    w = rows(n)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))
