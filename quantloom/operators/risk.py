"""Multi-factor risk model: exponentially weighted covariances and their adjustments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_date, decayed, div
from .regress import solve


def ew_weights(h: int, half_life: float) -> np.ndarray:
    w = 0.5 ** (np.arange(h - 1, -1, -1) / half_life)
    return w / w.sum()


def newey_west(x: np.ndarray, w: np.ndarray, lags: int, scalar_mean: bool = True) -> np.ndarray:
    """Weighted covariance of rows x (oldest first) with Bartlett-weighted lag terms.

    The mean is one number over all cells, as a convention; or per column.
    """
    mean = (w[:, None] * x).mean() if scalar_mean else w @ x
    z = x - mean
    out = (z * w[:, None]).T @ z
    for d in range(1, lags + 1):
        g = (z[d:] * w[d:, None]).T @ z[:-d]
        out += (1 - d / (lags + 1)) * (g + g.T)
    return out


def eigen_adjusted(cov: np.ndarray, n_dates: int, sims: int = 500, alpha: float = 1.2, seed: int = 0) -> np.ndarray:
    """Scales eigenvariances by the bias that simulated samples of the same length show."""
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values = np.maximum(values, 0)
    bias = np.zeros(len(values))
    for lo in range(0, sims, 100):
        n = min(100, sims - lo)
        b = vectors @ (rng.normal(size=(n, len(values), n_dates)) * np.sqrt(values)[:, None])
        b -= b.mean(axis=2, keepdims=True)
        d, u = np.linalg.eigh(b @ b.transpose(0, 2, 1) / n_dates)
        bias += (np.einsum("sik,ij,sjk->sk", u, cov, u) / np.maximum(d, 1e-18)).sum(axis=0)
    v = alpha * (np.sqrt(np.maximum(bias / sims, 0)) - 1) + 1
    return (vectors * (v**2 * values)) @ vectors.T


def factor_covariance(returns: DataFrame, h: int, half_life: float, lags: int = 4, pred: int = 1, eigen: bool = False) -> DataFrame:
    """(trade_date, i, j, value) from long factor returns (trade_date, date_idx, name, value), for each date with h full ones behind it.

    Each date's window goes to one task; its rows are h times the factors.
    """
    ends = returns.select(F.col("date_idx").alias("end_idx"), F.col("trade_date").alias("end_date")).distinct()
    windows = returns.join(F.broadcast(ends), (F.col("date_idx") <= F.col("end_idx")) & (F.col("date_idx") > F.col("end_idx") - h)).select("end_date", "end_idx", "date_idx", "name", "value")
    weights = ew_weights(h, half_life)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date_idx", columns="name", values="value").sort_index(axis=1)
        if len(wide) < h or wide.isna().any().any():
            return pd.DataFrame(columns=["trade_date", "i", "j", "value"], dtype=object)
        cov = newey_west(wide.to_numpy(float), weights, lags) * pred
        if eigen:
            cov = eigen_adjusted(cov, h, seed=int(pdf["end_idx"].iloc[0]))
        names = wide.columns.to_numpy()
        i, j = np.meshgrid(names, names, indexing="ij")
        return pd.DataFrame({"trade_date": pdf["end_date"].iloc[0], "i": i.ravel(), "j": j.ravel(), "value": cov.ravel()})

    return windows.groupBy("end_date").applyInPandas(run, "trade_date date, i string, j string, value double")


def idio_variance(residuals: DataFrame, h: int, half_life: float, least: int, pred: int = 1) -> DataFrame:
    """Exponentially weighted variance of each ticker's residuals over h dates; null with fewer than ``least``; at least 0.

    residuals: ticker, trade_date, date_idx, value.
    """
    w = Window.partitionBy("ticker").orderBy("date_idx").rowsBetween(-(h - 1), 0)
    x = F.col("value")
    mass, first, second = decayed(w, 0.5 ** (1 / half_life), F.when(x.isNotNull(), 1.0), x, x * x)
    var = F.greatest(second / mass - F.pow(first / mass, F.lit(2)), F.lit(0.0)) * pred
    return residuals.select("ticker", "trade_date", "date_idx", F.when(F.count(x).over(w) >= least, var).alias("var"))


def idio_newey_west(residuals: DataFrame, h: int, half_life: float, least: int, lags: int = 4, pred: int = 1) -> DataFrame:
    """(ticker, trade_date, date_idx, var): like ``idio_variance``, less the mean of the weighted residuals, with Bartlett-weighted lag terms.

    The mean m depends on the frame, so it is taken off the sums: with w the weights, the sum of w (x - m)(x' - m) over pairs at
    one lag is that of w x x', less m times that of w (x + x'), plus m^2 times that of w. Rows are dealt by ticker and go on in
    batches of many tickers' rows in order; a batch keeps the h - 1 rows before it, and its frames are summed side by side.
    """
    decay = 0.5 ** (1 / half_life)
    total = sum(decay**age for age in range(h))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for b in batches:
            rows = b if before is None else pd.concat([before, b], ignore_index=True)
            before = rows.iloc[max(0, len(rows) - h + 1) :]
            ticker, x = rows["ticker"], rows["value"].to_numpy("f8")
            same = (ticker == ticker.shift()) | (ticker.isna() & ticker.shift().isna())
            first = np.flatnonzero(~same.to_numpy() | (np.arange(len(rows)) == 0))
            nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))

            def back(v: np.ndarray, k: int, missing: float) -> np.ndarray:
                """The ticker's values k rows back."""
                out = np.full(len(v), missing)
                if k < len(v):
                    out[k:] = np.where(nth[k:] >= k, v[: len(v) - k], missing)
                return out

            def sums(span: int, *values: np.ndarray) -> list[np.ndarray]:
                """Of the last ``span`` rows, each counting ``decay`` times the next one; nulls as 0."""
                out = [np.zeros(len(rows)) for _ in values]
                for age in range(span - 1, -1, -1):
                    out = [t * decay + back(v, age, 0.0) for t, v in zip(out, values, strict=True)]
                return out

            there, z = ~np.isnan(x), np.nan_to_num(x, posinf=np.inf, neginf=-np.inf)
            n = sum(back(there.astype("f8"), age, 0.0) for age in range(h))
            mass, one, two = sums(h, there.astype("f8"), z, z * z)
            with np.errstate(divide="ignore", invalid="ignore"):
                m = one / total / n
                var = two - 2 * m * one + m * m * mass
                for k in range(1, min(lags, h - 1) + 1):
                    other = back(x, k, np.nan)
                    both = there & ~np.isnan(other)
                    mass_k, plus, times = sums(h - k, both.astype("f8"), np.where(both, x + other, 0.0), np.where(both, x * other, 0.0))
                    var = var + 2 * (1 - k / (lags + 1)) * (times - m * plus + m * m * mass_k)
                var = np.where(n >= max(least, 1), np.maximum(var / total, 0.0) * pred, np.nan)
            at = len(rows) - len(b)
            yield pd.DataFrame({"ticker": b["ticker"], "trade_date": b["trade_date"], "date_idx": b["date_idx"], "var": var[at:]})

    ordered = residuals.select("ticker", "trade_date", "date_idx", F.col("value").cast("double").alias("value")).repartition("ticker").sortWithinPartitions("ticker", "date_idx")
    got = ordered.mapInPandas(run, "ticker string, trade_date date, date_idx int, var double")
    return got.withColumn("var", F.nanvl("var", F.lit(None).cast("double")))


def robust_sigma(residuals: DataFrame, h: int, least: int) -> DataFrame:
    """std, (q75 - q25) / 1.35, and gamma = min(exp(1 - |std / robust - 1|), 1) over h dates."""
    w = Window.partitionBy("ticker").orderBy("date_idx").rowsBetween(-(h - 1), 0)
    ok = F.count("value").over(w) >= least
    r = residuals.withColumn("q", F.percentile("value", [0.25, 0.75]).over(w))
    r = r.withColumns({"std": F.when(ok, F.stddev("value").over(w)), "robust": F.when(ok, (F.col("q")[1] - F.col("q")[0]) / 1.35)})
    return r.drop("q").withColumn("gamma", F.least(F.exp(1 - F.abs(div("std", "robust") - 1)), F.lit(1.0)))


def structural(panel: DataFrame, factors: list[str], weight: str) -> DataFrame:
    """Blends sigma of names with gamma < 1 with exp(X b), b fitted on ln sigma of the others by weighted least squares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna()
        good = (d["gamma"] >= 1 - 1e-12) & (d["std"] > 0) & (d[weight] > 0)
        sigma = d["std"].to_numpy(float)
        if good.sum() > len(factors) + 1:
            x = np.hstack([np.ones((len(d), 1)), d[factors].to_numpy(float)])
            g = good.to_numpy()
            b = solve(x[g], np.log(sigma[g]), d[weight].to_numpy(float)[g])
            model = np.exp(x @ b)
            model *= np.average(sigma[g] / model[g], weights=d[weight].to_numpy(float)[g])
            gamma = d["gamma"].to_numpy(float)
            sigma = gamma * sigma + (1 - gamma) * model
        return pd.DataFrame({"trade_date": d["trade_date"], "ticker": d["ticker"], "sigma": sigma})

    return panel.select("trade_date", "ticker", "std", "gamma", weight, *factors).groupBy("trade_date").applyInPandas(run, "trade_date date, ticker string, sigma double")


def bayes_shrink(panel: DataFrame, sigma: str, size: str, n: int = 10, q: float = 1.0) -> DataFrame:
    """Shrinks sigma to the cap-weighted mean of its size group; the more, the less it differs for its group."""
    p = panel.where(F.col(sigma).isNotNull() & F.col(size).isNotNull()).withColumn("edges", F.percentile(size, [i / n for i in range(1, n)]).over(by_date()))
    p = p.withColumn("grp", F.size(F.filter("edges", lambda e: F.col(size) > e)))
    g = Window.partitionBy("trade_date", "grp")
    p = p.withColumn("mean", div(F.sum(F.col(sigma) * F.col(size)).over(g), F.sum(size).over(g)))
    p = p.withColumn("spread", F.sqrt(F.avg(F.pow(F.col(sigma) - F.col("mean"), F.lit(2))).over(g)))
    off = q * F.abs(F.col(sigma) - F.col("mean"))
    v = F.coalesce(div(off, F.col("spread") + off), F.lit(0.0))
    return p.select("ticker", "trade_date", "grp", (v * F.col("mean") + (1 - v) * F.col(sigma)).alias("shrunk"))


def vol_regime(panel: DataFrame, ret: str, sigma: str, h: int, half_life: float) -> DataFrame:
    """Per date: cross-sectional bias b = mean((ret / sigma)^2), 1 where it is 100 or more, and the root of its weighted mean over h dates."""
    x = F.pow(div(ret, sigma), F.lit(2))
    per_date = panel.groupBy("trade_date", "date_idx").agg(F.avg(x).alias("b2"))
    per_date = per_date.withColumn("b2", F.when(F.col("b2") >= 100, 1.0).otherwise(F.col("b2")))
    w = Window.orderBy("date_idx").rowsBetween(-(h - 1), 0)  # a row per date
    mass, total = decayed(w, 0.5 ** (1 / half_life), F.when(F.col("b2").isNotNull(), 1.0), F.col("b2"))
    return per_date.withColumn("multiplier", F.sqrt(div(total, mass)))


def factor_regime(returns: DataFrame, cov: DataFrame, h: int, half_life: float) -> DataFrame:
    """Per date: mean((factor return / its volatility)^2) over the factors, and the root of its weighted mean over h dates."""
    own = cov.where("i = j").select("trade_date", F.col("i").alias("name"), F.sqrt(F.greatest("value", F.lit(1e-18))).alias("sigma"))
    got = vol_regime(returns.select("trade_date", "date_idx", "name", "value").join(own, ["trade_date", "name"]), "value", "sigma", h, half_life)
    return got.select("trade_date", "b2", "multiplier")


def adjusted_factor_covariance(returns: DataFrame, h: int, half_life: float, lags: int = 4, pred: int = 1, eigen: bool = True, regime: tuple[int, float] | None = (60, 20)) -> DataFrame:
    """Factor covariances: raw with Newey-West, then eigen-adjusted, then scaled by the volatility regime; each step but the first can be left out."""
    cov = factor_covariance(returns, h, half_life, lags, pred, eigen)
    if not regime:
        return cov
    scale = F.broadcast(factor_regime(returns, cov, *regime).select("trade_date", "multiplier"))  # a row per date
    return cov.join(scale, "trade_date").select("trade_date", "i", "j", (F.col("value") * F.coalesce(F.pow("multiplier", F.lit(2)), F.lit(1.0))).alias("value"))


def adjusted_idio(residuals: DataFrame, panel: DataFrame, factors: list[str], weight: str, ret: str, h: int, half_life: float, least: int, lags: int = 4, structure: tuple[int, int] | None = (20, 8), shrink: bool = True, regime: tuple[int, float] | None = (60, 20)) -> DataFrame:
    """(ticker, trade_date, idio): variances raw with Newey-West, then blended with a structural model, shrunk to size groups and scaled by the volatility regime; each step but the first can be left out.

    A step reads the one before it several times, so each is cached: no step runs more than once.
    """
    residuals = residuals.select("ticker", "trade_date", "date_idx", "value").cache()
    raw = idio_newey_west(residuals, h, half_life, least, lags).select("ticker", "trade_date", F.sqrt("var").alias("sigma"))
    p = panel.select("ticker", "trade_date", "date_idx", ret, weight, *factors).join(raw, ["ticker", "trade_date"])
    if structure:
        p = p.join(robust_sigma(residuals, *structure).select("ticker", "trade_date", "gamma"), ["ticker", "trade_date"]).cache()
        model = structural(p.withColumnRenamed("sigma", "std"), factors, weight).withColumnRenamed("sigma", "blended")
        p = p.join(model, ["ticker", "trade_date"], "left").withColumn("sigma", F.coalesce("blended", "sigma")).drop("blended", "gamma")
    if shrink:
        p = p.cache()
        p = p.join(bayes_shrink(p, "sigma", weight).select("ticker", "trade_date", "shrunk"), ["ticker", "trade_date"], "left").withColumn("sigma", F.coalesce("shrunk", "sigma")).drop("shrunk")
    if regime:
        p = p.cache()
        scale = F.broadcast(vol_regime(p, ret, "sigma", *regime).select("trade_date", "multiplier"))  # a row per date
        p = p.join(scale, "trade_date").withColumn("sigma", F.col("sigma") * F.coalesce("multiplier", F.lit(1.0)))
    return p.select("ticker", "trade_date", F.pow("sigma", F.lit(2)).alias("idio"))


def asset_covariance(x: np.ndarray, f: np.ndarray, idio: np.ndarray) -> np.ndarray:
    """X F X' + diag(idio); missing idio as the mean, missing exposure as 0."""
    load, own = asset_factors(x, f, idio)
    return load @ load.T + np.diag(own)


def asset_factors(x: np.ndarray, f: np.ndarray, idio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and d of the same covariance, L L' + diag(d)."""
    values, vectors = np.linalg.eigh((f + f.T) / 2)
    return np.nan_to_num(x) @ (vectors * np.sqrt(np.maximum(values, 0))), np.where(np.isnan(idio), np.nanmean(idio), idio)
