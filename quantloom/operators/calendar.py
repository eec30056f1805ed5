"""Calendar look-ups, rebalance paths and walk-forward windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    """All dates; calendars have a row per date."""
    return Window.orderBy("trade_date")


def neighbours(cal: DataFrame) -> DataFrame:
    """Each date with the next and the previous one (null at the ends)."""
    return cal.withColumns({"next_date": F.lead("trade_date").over(in_order()), "prev_date": F.lag("trade_date").over(in_order())})


def nth_previous(cal: DataFrame, n: int) -> DataFrame:
    """Each date with the n-th previous (negative: following) one, held at the calendar's ends."""
    last = F.max("date_idx").over(Window.partitionBy())
    want = cal.withColumn("want", F.greatest(F.lit(0), F.least(last, F.col("date_idx") - n)))
    return want.join(F.broadcast(cal.select(F.col("date_idx").alias("want"), F.col("trade_date").alias("nth_date"))), "want").drop("want")


def asof_previous(dates: DataFrame, cal: DataFrame) -> DataFrame:
    """For any date d: the last calendar date before the first one at or after d, and the first after the last one at or before d."""
    d, c = dates.alias("d"), F.broadcast(cal).alias("c")
    return d.join(c, F.lit(True), "left").groupBy("d.d").agg(F.max(F.when(F.col("c.trade_date") < F.col("d.d"), F.col("c.trade_date"))).alias("prev_date"), F.min(F.when(F.col("c.trade_date") > F.col("d.d"), F.col("c.trade_date"))).alias("next_date"))


def paths(cal: DataFrame, n: int) -> DataFrame:
    """Rebalance paths: path i has every n-th date from the i-th on."""
    return cal.withColumn("path_id", F.col("date_idx") % n)


def week_paths(cal: DataFrame) -> DataFrame:
    """For each weekday 1..5 and ISO week with any date: the week's last date up to that weekday, else the path's previous one."""
    days = cal.select("trade_date", F.date_trunc("week", "trade_date").cast("date").alias("week"), (F.weekday("trade_date") + 1).alias("dow")).where("dow <= 5")
    weeks = days.select("week").distinct().crossJoin(cal.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("path_id")))
    hit = weeks.join(days, "week", "left").groupBy("week", "path_id").agg(F.max(F.when(F.col("dow") <= F.col("path_id"), F.col("trade_date"))).alias("own"))
    back = Window.partitionBy("path_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return hit.withColumn("trade_date", F.last("own", ignorenulls=True).over(back)).drop("own")


def walk_forward(n_dates: int, train: int = 240, test: int = 40, step: int = 40, delay: int = 1, mode: str = "rolling") -> Iterator[tuple[int, int, int, int, int]]:
    """(window, first and last training index, first and last test index), ends included.

    rolling: windows of ``train`` dates; expanding: all dates so far; bisect: each window of ``train``
    dates is cut in two, and its last ``test`` dates, less the delay, are tested.
    """
    k, start = 0, 0
    while start + train + (0 if mode == "bisect" else delay) < n_dates + (mode == "bisect"):
        lo, hi = (0 if mode == "expanding" else start), start + train - 1
        if mode == "bisect":
            yield k, lo, hi - test, hi - test + 1 + delay, hi
        else:
            yield k, lo, hi, hi + 1 + delay, min(hi + delay + test, n_dates - 1)
        k, start = k + 1, start + step


def filled_weights(weights: DataFrame, cal: DataFrame) -> DataFrame:
    """Weights (ticker, trade_date, w) on all calendar dates: on a date without any, each ticker keeps its last one before."""
    there = weights.select("trade_date").distinct().withColumn("there", F.lit(True))
    grid = weights.select("ticker").distinct().crossJoin(F.broadcast(cal.select("trade_date", "date_idx").join(there, "trade_date", "left")))
    back = Window.partitionBy("ticker").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    dense = grid.join(weights, ["ticker", "trade_date"], "left").withColumn("known", F.when(F.col("there"), F.coalesce("w", F.lit(0.0))))
    return dense.select("ticker", "trade_date", "date_idx", F.last("known", ignorenulls=True).over(back).alias("w"))


def trimmed(panel: DataFrame, cal: DataFrame, back: int, ahead: int) -> DataFrame:
    """The panel without its first ``back`` and its last ``ahead`` dates."""
    end = F.broadcast(cal.agg(F.max("date_idx").alias("end_idx")))  # one row
    return panel.crossJoin(end).where((F.col("date_idx") >= back) & (F.col("date_idx") <= F.col("end_idx") - ahead)).drop("end_idx")


def with_missing_dates(series: DataFrame, cal: DataFrame) -> DataFrame:
    """All calendar dates, null where the series has none."""
    return cal.select("trade_date").join(series, "trade_date", "left")
