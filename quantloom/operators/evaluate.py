"""Evaluation of one factor from panel to a summary record of one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import backtest as B

MEASURES = ("alpha_rtn", "alpha_sharpe", "alpha_drawdown", "rtn", "drawdown")


@dataclass(frozen=True)
class Setting:
    """How a factor is tested; kept in its record."""

    winsorize: str = ""
    standardize: str = ""
    neutralize: str = ""
    pool: str = "all"
    head: int = 10
    adj_freq: int = 3
    rate: float = 0.003


def side(signals: DataFrame, w: str, ret: str, bench: DataFrame, rate: float) -> DataFrame:
    """The mean over paths of one side's series, with the benchmark."""
    return B.over_paths(B.portfolio(signals, w, ret, rate)).join(F.broadcast(bench), "trade_date")  # a row per date


def summary(series: DataFrame, prefix: str) -> DataFrame:
    """One row: the measures after cost and (``_gross``) without, turnover and cost."""
    net = B.performance(series).where("year = 'sum'").select(*[F.col(c).alias(f"{prefix}_{c}") for c in (*MEASURES, "turnover", "cost")])
    gross = B.performance(series, "gross").where("year = 'sum'").select(*[F.col(c).alias(f"{prefix}_{c}_gross") for c in MEASURES])
    return net.crossJoin(F.broadcast(gross))  # one row each


def evaluate(panel: DataFrame, factor: str, ret: str, ic_ret: str, name: str, setting: Setting = Setting()) -> DataFrame:
    """The record of a factor: 10 columns of its setting, 5 of its information coefficient, and 12 each of the better, the long and the short side.

    The better side is the long one unless the short one has more alpha after cost.
    """
    signals = B.top_bottom(panel, factor, setting.head, setting.adj_freq).cache()
    bench = B.benchmark(panel, ret)
    long, short = (summary(side(signals, f"{k}_w", ret, bench, setting.rate), k) for k in ("long", "short"))
    ic = B.ic_stats(B.ic(panel, factor, ic_ret)).select(F.col("mean").alias("ic_mean"), F.col("pos_ratio").alias("ic_pos_ratio"), F.col("neg_ratio").alias("ic_neg_ratio"), F.col("sig_ratio").alias("ic_sig_ratio"), F.col("ir").alias("ir"))
    dates = panel.agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    rows = dates
    for one in (ic, long, short):
        rows = rows.crossJoin(F.broadcast(one))  # one row each
    cols = [*MEASURES, *[f"{m}_gross" for m in MEASURES], "turnover", "cost"]
    better = F.coalesce(F.col("short_alpha_rtn") > F.col("long_alpha_rtn"), F.lit(False))
    best = [F.when(better, F.col(f"short_{c}")).otherwise(F.col(f"long_{c}")).alias(f"best_{c}") for c in cols]
    fixed = [F.lit(v).alias(k) for k, v in (("factor", name), ("winsorize", setting.winsorize), ("standardize", setting.standardize), ("neutralize", setting.neutralize), ("pool", setting.pool), ("head", setting.head), ("adj_freq", setting.adj_freq), ("rate", setting.rate))]
    return rows.select(*fixed, "start_date", "end_date", "ic_mean", "ic_pos_ratio", "ic_neg_ratio", "ic_sig_ratio", "ir", *best, *[f"long_{c}" for c in cols], *[f"short_{c}" for c in cols])


def evaluate_signal(signals: DataFrame, panel: DataFrame, ret: str, name: str, setting: Setting = Setting(), long_only: bool = False, run_at: str = "") -> DataFrame:
    """The record of a signal, of 43 columns: 7 of its setting, and 12 each of the better, the long and the short side.

    signals: path_id, ticker, trade_date, date_idx, ``ret`` and the weights long_w and short_w. The better side is the long one unless the
    short one has more alpha after cost; always the long one with ``long_only``. ``run_at`` is the time that the caller gives the run.
    """
    bench = B.benchmark(panel, ret)
    long, short = (summary(side(signals, f"{k}_w", ret, bench, setting.rate), k) for k in ("long", "short"))
    rows = panel.agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date")).crossJoin(F.broadcast(long)).crossJoin(F.broadcast(short))  # one row each
    cols = [*MEASURES, *[f"{m}_gross" for m in MEASURES], "turnover", "cost"]
    better = F.lit(False) if long_only else F.coalesce(F.col("short_alpha_rtn") > F.col("long_alpha_rtn"), F.lit(False))
    best = [F.when(better, F.col(f"short_{c}")).otherwise(F.col(f"long_{c}")).alias(f"best_{c}") for c in cols]
    fixed = [F.lit(v).alias(k) for k, v in (("signal", name), ("run_at", run_at), ("pool", setting.pool), ("head", setting.head), ("adj_freq", setting.adj_freq))]
    return rows.select(*fixed, "start_date", "end_date", *best, *[f"long_{c}" for c in cols], *[f"short_{c}" for c in cols])


def signal_curves(long: DataFrame, short: DataFrame) -> DataFrame:
    """trade_date, running net sums of the long and the short side, their difference, the better side's (the long one unless it ends lower), and its drawdown."""
    both = long.select("trade_date", F.col("net").alias("l_net")).join(short.select("trade_date", F.col("net").alias("s_net")), "trade_date")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    c = both.select("trade_date", *[F.sum(F.coalesce(x, F.lit(0.0))).over(w).alias(k) for k, x in (("long", "l_net"), ("short", "s_net"))])
    end = c.agg(F.coalesce(F.max_by("long", "trade_date") >= F.max_by("short", "trade_date"), F.lit(True)).alias("up"))
    c = c.crossJoin(F.broadcast(end)).withColumn("best", F.when(F.col("up"), F.col("long")).otherwise(F.col("short")))  # one row
    return c.select("trade_date", "long", "short", (F.col("long") - F.col("short")).alias("long_short"), "best", (F.col("best") - F.max("best").over(w)).alias("drawdown"))


def curves(long: DataFrame, short: DataFrame) -> DataFrame:
    """trade_date, running sums of the long side, the short side, and of long net - 2 x short gross + short net (the short side is sold, its cost stays)."""
    both = long.select("trade_date", F.col("net").alias("l_net")).join(short.select("trade_date", F.col("net").alias("s_net"), F.col("gross").alias("s_gross")), "trade_date")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    parts = {"long": F.col("l_net"), "short": F.col("s_net"), "long_short": F.col("l_net") - 2 * F.col("s_gross") + F.col("s_net")}
    return both.select("trade_date", *[F.sum(F.coalesce(x, F.lit(0.0))).over(w).alias(k) for k, x in parts.items()])
