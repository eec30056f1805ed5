"""Exposures and attribution of holdings against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_date, div, lag


def active(panel: DataFrame, holding: str, bench: str) -> DataFrame:
    """Adds w and wb, both summing to 1 on a date, and their difference wa."""
    share = {n: F.coalesce(div(c, F.sum(c).over(by_date())), F.lit(0.0)) for n, c in (("w", holding), ("wb", bench))}
    return panel.withColumns(share).withColumn("wa", F.col("w") - F.col("wb"))


def style(panel: DataFrame, factors: list[str]) -> DataFrame:
    """Long (trade_date, factor, exposure): sums of exposure times active weight."""
    wide = panel.groupBy("trade_date").agg(*[F.sum(F.coalesce(F.col(f), F.lit(0.0)) * F.col("wa")).alias(f) for f in factors])
    return wide.unpivot(["trade_date"], factors, "factor", "exposure")


def grouped(panel: DataFrame, group: str, ret: str) -> DataFrame:
    """Per date and group: active weight, the group's mean return, and their product."""
    got = panel.groupBy("trade_date", group).agg(F.sum("wa").alias("exposure"), F.avg(ret).alias("group_ret"))
    return got.withColumn("attribution", F.col("exposure") * F.col("group_ret"))


def explained(panel: DataFrame, fitted: str) -> DataFrame:
    """Per date: what fitted returns explain of the active return, and the active return."""
    return panel.groupBy("trade_date").agg(F.sum(F.col(fitted) * F.col("wa")).alias("explained"), F.sum(F.col("ret") * F.col("wa")).alias("active_ret"))


def yearly(series: DataFrame, key: str, exposure: str, attribution: str) -> DataFrame:
    """Mean exposure and summed attribution per year, and for 'sum'."""
    s = series.withColumn("year", F.explode(F.array(F.year("trade_date").cast("string"), F.lit("sum"))))
    return s.groupBy("year", key).agg(F.avg(exposure).alias("mean_exposure"), F.sum(attribution).alias("total_attribution"))


def risk_inputs(panel: DataFrame, factors: list[str], index: str, returns: DataFrame, close: str = "close", value: str = "value") -> DataFrame:
    """What an attribution starts from, on the panel's rows: exposures of the same date (the panel has those of the date before), the weight in percent in the ticker's index, the index's close, and the date's factor returns (``returns``, a row per date)."""
    group = Window.partitionBy("trade_date", index)
    held = F.sum(F.when(F.col(close).isNotNull(), F.col(value))).over(group)
    p = panel.withColumns({f: lag(f, -1) for f in factors})
    p = p.withColumns({"weight": 100 * div(value, F.sum(value).over(group)), "index_close": div(F.sum(F.col(close) * F.col(value)).over(group), held)})
    return p.join(F.broadcast(returns), "trade_date", "left")  # a row per date
