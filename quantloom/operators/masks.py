"""Membership, listing, suspension and feasibility masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, bfill, div, lag, rows, with_date


def index_weights(panel: DataFrame, group: str = "region", value: str = "value") -> DataFrame:
    """Constituent weights in percent: shares of the group's value on the date."""
    p = panel.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("index_code"), "ticker", "trade_date", F.col(value).alias("own"))
    return with_date(p, "index_code", whole=F.sum("own")).select("index_code", "ticker", "trade_date", (100 * div("own", "whole")).alias("weight"))


def members(weights: DataFrame, codes: list[str]) -> DataFrame:
    """(ticker, trade_date) that have a weight in any of the indices."""
    return weights.where(F.col("index_code").isin(codes) & F.col("weight").isNotNull()).select("ticker", "trade_date").distinct()


def restrict(panel: DataFrame, mask: DataFrame) -> DataFrame:
    return panel.join(mask, ["ticker", "trade_date"], "left_semi")


def restrict_to(panel: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Rows of a static list of tickers, as a filter that reaches the scan."""
    return panel.where(F.col("ticker").isin(list(tickers)))


def held(weights: DataFrame, blacklist: Sequence[str] = (), least: float = 1e-6) -> DataFrame:
    """Rows of weights above ``least``, without the tickers of a blacklist."""
    rows = weights.where(F.col("w") > least)
    return rows.where(~F.col("ticker").isin(list(blacklist))) if blacklist else rows


def listed(days: int = 60, price: str = "close") -> Column:
    """After the ``days``-th date that follows the first one with a price."""
    first = F.min(F.when(F.col(price).isNotNull(), F.col("date_idx"))).over(by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.col("date_idx") > first + days


def unsuspended(n: int = 10, growing: bool = False) -> Column:
    """No missing bar in the last n dates; the first n - 1 dates fail, or look back as far as they can if ``growing``."""
    gaps = F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).over(rows(n))
    return (gaps == 0) & (F.lit(True) if growing else F.col("date_idx") >= n - 1)


def buyable(limit: float = 1.1) -> Column:
    """Traded, and opened below the upper limit of the previous close."""
    return F.coalesce(F.col("open").isNotNull() & (F.col("preclose") * limit - F.col("open") > 1e-6), F.lit(False))


def sellable(limit: float = 0.9) -> Column:
    return F.coalesce(F.col("open").isNotNull() & (F.col("open") - F.col("preclose") * limit > 1e-6), F.lit(False))


def overnight(limit: float = 1.1) -> Column:
    return F.coalesce(F.col("close") <= F.col("preclose") * limit - 0.01, F.lit(False))


def limit_flag() -> Column:
    """1 or -1 if the bar has a single price above or below the previous close, else 0."""
    return F.when((F.col("high") == F.col("low")) & F.col("preclose").isNotNull(), F.signum(F.col("close") / F.col("preclose") - 1)).otherwise(0.0)


def close_at_limit(up: bool, rate: float = 0.1, wide: float = 0.2, prefix: str = "00000") -> Column:
    """Close at the limit, which is wider for tickers with a prefix."""
    r = F.when(F.col("ticker").startswith(prefix), wide).otherwise(rate) - 0.001
    move = F.col("close") / F.col("preclose") - 1
    return F.coalesce(move >= r if up else move <= -r, F.lit(False))


def feasible(days: int, n: int) -> tuple[Column, Column]:
    """Buying is feasible on the next date; selling on this one."""
    return lag(buyable() & listed(days) & unsuspended(n), -1), sellable() & listed(days)


def next_feasible_price(price: str = "open") -> Column:
    """The price of the next date on which selling is feasible, on dates that have a price."""
    return F.when(F.col(price).isNotNull(), bfill(F.when(sellable(), F.col(price))))
