"""Style factors and preprocessing as column expressions, and a registry of user factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_date, by_ticker, clip, div, ew_kernel, lag, masked, pair, rank_avg, rolling, weighted_mean, with_date, zscore

FACTORS: dict[str, tuple[Callable[..., Column], list[tuple]]] = {}


def factor(name: str, params: list[tuple] = ((),)):
    """Register a function of parameters that gives a column; each parameter tuple makes a factor name_p1_p2."""

    def add(f):
        FACTORS[name] = (f, list(params))
        return f

    return add


def expand(name: str) -> dict[str, Column]:
    f, grid = FACTORS[name]
    return {"_".join([name, *map(str, p)]): f(*p) for p in grid}


def compute(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """ticker, trade_date and all factors of the grid; one pass over the panel's ticker partitions."""
    cols = {k: c for n in names or FACTORS for k, c in expand(n).items()}
    return panel.select("ticker", "trade_date", "date_idx", *[c.alias(k) for k, c in cols.items()])


@factor("mom", [(3,), (6,)])
def mom(window: int) -> Column:
    return div("vwap", lag("vwap", window)) - 1


@factor("rev", [(10, 5)])
def reversal(n: int, half_life: float) -> Column:
    return masked(ew_kernel("ret", n, half_life), "open")


@factor("high_low", [(5,), (10,)])
def high_low(n: int) -> Column:
    return div(rolling(F.max, "high", n), rolling(F.min, "low", n))


@factor("std", [(5,), (10,)])
def volatility(n: int) -> Column:
    return rolling(F.stddev, div("close", "preclose"), n)


@factor("turn", [(1,), (5,)])
def turnover(n: int) -> Column:
    return rolling(F.avg, "turnover", n)


@factor("w_mom", [(5,)])
def weighted_momentum(n: int) -> Column:
    return div(rolling(F.avg, F.col("turnover") * F.col("ret"), n), rolling(F.avg, "turnover", n))


@factor("size")
def size() -> Column:
    return F.when(F.col("cap") > 0, F.log10("cap"))


def lagged_momentum(panel: DataFrame, n: int, half_life: float, skip: int) -> DataFrame:
    """Kernel momentum of returns that end ``skip`` dates ago."""
    return panel.withColumn("old", lag("ret", skip)).select("ticker", "trade_date", "date_idx", ew_kernel("old", n, half_life).alias("value"))


def industry_momentum(panel: DataFrame, n: int) -> DataFrame:
    """(1 - 1/k) (industry mean - ret/k) with missing returns as 0, averaged over n dates; k: the industry's size."""
    by = Window.partitionBy("trade_date", "industry")
    x = F.coalesce(F.col("ret"), F.lit(0.0))
    k = F.count(F.lit(1)).over(by)
    return panel.withColumn("own", (1 - 1 / k) * (F.avg(x).over(by) - x / k)).select("ticker", "trade_date", "date_idx", rolling(F.avg, "own", n).alias("value"))


def nonlinear_size(panel: DataFrame) -> DataFrame:
    """ln(cap)^3 less its projection on ln(cap): covariance by n - 1, variance by n."""
    s = F.when(F.col("cap") > 0, F.ln("cap"))
    beta = div(F.covar_samp(s * s * s, s).over(by_date()), F.var_pop(s).over(by_date()))
    return panel.select("ticker", "trade_date", "date_idx", (s * s * s - beta * s).alias("value"))


def market(panel: DataFrame) -> DataFrame:
    """Cap-weighted return per date, by the previous date's cap."""
    return panel.withColumn("old_cap", lag("cap")).groupBy("trade_date").agg(weighted_mean("ret", "old_cap").alias("mkt"))


def capm(panel: DataFrame, n: int = 252, least: int = 50) -> DataFrame:
    """beta, alpha and residual deviation of the n dates before each one.

    Residuals are market less beta x stock, so all three follow from moments of the window.
    """
    both = panel.join(F.broadcast(market(panel)), "trade_date")  # a row per date
    x, m = pair(F.col("ret"), F.col("mkt"))
    w = by_ticker().rowsBetween(-n, -1)
    enough = F.count(x).over(w) >= least
    beta = F.when(enough, div(F.covar_samp(x, m).over(w), F.var_pop(x).over(w)))
    var = F.var_pop(m).over(w) + beta * beta * F.var_pop(x).over(w) - 2 * beta * F.covar_pop(x, m).over(w)
    return both.select("ticker", "trade_date", "date_idx", beta.alias("beta"), (F.avg(m).over(w) - beta * F.avg(x).over(w)).alias("alpha"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("err_std"))


def trimmed_normal(panel: DataFrame, x: str, lo: float = 0.01, hi: float = 0.99, weight: str | None = "cap") -> DataFrame:
    """Lagged by one date, cut to the quantile band, and standardised around the (cap-weighted) mean."""
    p = panel.withColumn("x", lag(x)).withColumn("q", F.percentile("x", [lo, hi]).over(by_date()))
    p = p.withColumn("x", F.when(F.col("x").between(F.col("q")[0], F.col("q")[1]), F.col("x")))
    mean = weighted_mean("x", weight, by_date()) if weight else F.avg("x").over(by_date())
    return p.select("ticker", "trade_date", "date_idx", div(F.col("x") - mean, F.stddev("x").over(by_date())).alias("value"))


def merged(panel: DataFrame, parts: list[str], weight: str = "cap") -> DataFrame:
    """Mean of the parts that are there, standardised around the cap-weighted mean."""
    n = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in parts)
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in parts)
    p = panel.select("ticker", "trade_date", "date_idx", F.try_divide(total, F.when(n > 0, n)).alias("x"), F.col(weight).alias("weight"))
    p = with_date(p, mean=weighted_mean("x", "weight"), spread=F.stddev("x"))
    return p.select("ticker", "trade_date", "date_idx", div(F.col("x") - F.col("mean"), "spread").alias("value"))


def for_regression(panel: DataFrame, x: str) -> DataFrame:
    """Null outside the 5 % and 95 % quantiles, standardised, nulls as 0."""
    p = panel.withColumn("q", F.percentile(x, [0.05, 0.95]).over(by_date())).withColumn("x", F.when(F.col(x).between(F.col("q")[0], F.col("q")[1]), F.col(x)))
    return p.select("ticker", "trade_date", "date_idx", F.coalesce(zscore("x"), F.lit(0.0)).alias("value"))


def winsorize(panel: DataFrame, x: str, how: str, k: float = 3.0, q: float = 0.05) -> DataFrame:
    """Clipped to quantiles, to k deviations around the median, or to k x 1.483 mean absolute deviations around it."""
    return winsorized(panel, x, "value", how, k, q).select("ticker", "trade_date", "date_idx", "value")


def winsorized(panel: DataFrame, x: str, name: str, how: str, k: float = 3.0, q: float = 0.05) -> DataFrame:
    """The panel with ``x`` winsorized as ``name``; all windows are those of a date."""
    med = F.median(x).over(by_date())
    if how == "quantile":
        p = panel.withColumn("q", F.percentile(x, [q, 1 - q]).over(by_date()))
        lo, hi = F.col("q")[0], F.col("q")[1]
    elif how == "sigma":
        p, wide = panel, k * F.stddev(x).over(by_date())
        lo, hi = med - wide, med + wide
    else:
        p = panel.withColumn("off", F.abs(F.col(x) - F.avg(x).over(by_date())))
        wide = k * 1.483 * F.avg("off").over(by_date())
        lo, hi = med - wide, med + wide
    p = p.withColumns({"_lo": lo, "_hi": hi}).withColumn(name, clip(F.col(x), F.col("_lo"), F.col("_hi")))
    return p.drop("_lo", "_hi", *{"quantile": ["q"], "sigma": []}.get(how, ["off"]))


def standardize(panel: DataFrame, x: str, how: str) -> DataFrame:
    if how == "z":
        return panel.select("ticker", "trade_date", "date_idx", zscore(x).alias("value"))
    return panel.withColumn("rk", rank_avg(x)).select("ticker", "trade_date", "date_idx", zscore("rk").alias("value"))


def neutralize(panel: DataFrame, x: str, by: str = "cap", group: str = "industry") -> DataFrame:
    """Residual of x on ln(cap) per date, then standardised inside each industry."""
    s = F.when(F.col(by) > 0, F.ln(by))
    a, b = pair(F.col(x), s)
    slope = div(F.covar_pop(a, b).over(by_date()), F.var_pop(b).over(by_date()))
    p = panel.withColumn("res", a - F.avg(a).over(by_date()) - slope * (b - F.avg(b).over(by_date())))
    return p.select("ticker", "trade_date", "date_idx", zscore("res", Window.partitionBy("trade_date", group)).alias("value"))


def process(panel: DataFrame, x: str) -> DataFrame:
    """Winsorize, neutralize, standardize."""
    second = neutralize(winsorized(panel, x, "w1", "mad"), "w1").withColumnRenamed("value", "w2")
    return standardize(second, "w2", "z")
