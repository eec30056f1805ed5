"""Constrained mean-variance portfolios: an interior-point solver, four objectives, relaxation and the day loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import div
from .risk import asset_factors


class Dense:
    """A quadratic form and constraints as plain matrices."""

    def __init__(self, p: np.ndarray, g: np.ndarray, a: np.ndarray):
        self.p, self.g, self.a = p, g, a

    def quad(self, x: np.ndarray) -> np.ndarray:
        return self.p @ x

    def bound(self, x: np.ndarray) -> np.ndarray:
        return self.g @ x

    def back(self, z: np.ndarray) -> np.ndarray:
        return self.g.T @ z

    def solver(self, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """Solves (P + G' diag(w) G) d = r for given r."""
        m = self.p + self.g.T @ (self.g * w[:, None]) + RIDGE * np.eye(len(self.p))
        return lambda r: np.linalg.solve(m, r)


class Portfolio:
    """The same for weights x and trades y of n names: x'(diag + L L')x, few dense rows, 0 <= x <= upper, and y >= |x - before|.

    Everything but the dense rows and L is diagonal in each name, so the system is solved by names and
    a small dense part (Woodbury), with work n times the number of factors and rows squared.
    """

    def __init__(self, diag: np.ndarray, load: np.ndarray, rows: np.ndarray, traded: bool):
        self.n, self.diag, self.traded = len(diag), diag, traded
        self.load = np.vstack([load, np.zeros((self.n if traded else 0, load.shape[1]))])
        self.rows, self.a = rows, np.hstack([np.ones((1, self.n)), np.zeros((1, self.n if traded else 0))])

    def quad(self, x: np.ndarray) -> np.ndarray:
        out = self.load @ (self.load.T @ x)
        out[: self.n] += self.diag * x[: self.n]
        return out

    def bound(self, v: np.ndarray) -> np.ndarray:
        x, y = v[: self.n], v[self.n :]
        return np.concatenate([self.rows @ v, -x, x, *([x - y, -x - y] if self.traded else [])])

    def parts(self, z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        r = len(self.rows)
        return z[:r], [z[r + i * self.n : r + (i + 1) * self.n] for i in range(4 if self.traded else 2)]

    def back(self, z: np.ndarray) -> np.ndarray:
        dense, own = self.parts(z)
        x = own[1] - own[0] + (own[2] - own[3] if self.traded else 0)
        return self.rows.T @ dense + (np.concatenate([x, -own[2] - own[3]]) if self.traded else x)

    def solver(self, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        dense, own = self.parts(w)
        xx = self.diag + own[0] + own[1] + RIDGE
        if self.traded:
            yy, xy = own[2] + own[3] + RIDGE, own[3] - own[2]
            xx = xx + own[2] + own[3]
            # xx * yy - xy ** 2, without the terms that cancel
            det = (self.diag + own[0] + own[1] + RIDGE) * yy + RIDGE * (own[2] + own[3]) + 4 * own[2] * own[3]

        def names(r: np.ndarray) -> np.ndarray:
            if not self.traded:
                return r / (xx if r.ndim == 1 else xx[:, None])
            d, e, f, g = (v if r.ndim == 1 else v[:, None] for v in (det, xx, yy, xy))
            x, y = r[: self.n], r[self.n :]
            return np.concatenate([(f * x - g * y) / d, (e * y - g * x) / d])

        u = np.hstack([self.load, self.rows.T * np.sqrt(dense)])
        bu = names(u)
        inner = np.eye(u.shape[1]) + u.T @ bu

        def once(r: np.ndarray) -> np.ndarray:
            br = names(r)
            return br - bu @ np.linalg.solve(inner, u.T @ br)

        def full(x: np.ndarray) -> np.ndarray:
            return self.quad(x) + self.back(w * self.bound(x)) + RIDGE * x

        def both(r: np.ndarray) -> np.ndarray:
            x = once(r)
            return x + once(r - full(x))  # refined once

        return lambda r: both(r) if r.ndim == 1 else np.stack([both(c) for c in r.T], axis=1)


RIDGE = 1e-11


def descend(form: Dense | Portfolio, c: np.ndarray, h: np.ndarray, b: np.ndarray, steps: int = 200, gap: float = 1e-8) -> np.ndarray | None:
    """min x'Px/2 + c'x with Gx <= h and Ax = b, by predictor and corrector steps; None if it isn't solved."""
    a, m, k = form.a, len(h), len(b)
    x, y, z, s = np.zeros(len(c)), np.zeros(k), np.ones(m), np.maximum(h, 1.0)
    for _ in range(steps):
        dual, prime, eq, mu = form.quad(x) + c + form.back(z) + a.T @ y, form.bound(x) + s - h, a @ x - b, s @ z / max(m, 1)
        if mu < gap and np.abs(dual).max(initial=0) < 1e-6 and np.abs(prime).max(initial=0) < 1e-6 and np.abs(eq).max(initial=0) < 1e-6:
            return x
        try:
            solve = form.solver(z / s)
            at = solve(a.T) if k else np.zeros((len(c), 0))
            schur = a @ at + RIDGE * np.eye(k)

            def step(comp: np.ndarray) -> tuple[np.ndarray, ...]:
                first = solve(-dual - form.back((z * prime - comp) / s))
                dy = np.linalg.solve(schur, a @ first + eq) if k else np.zeros(0)
                d = first - at @ dy
                ds = -prime - form.bound(d)
                return d, dy, (-comp - z * ds) / s, ds

            def reach(v: np.ndarray, d: np.ndarray) -> float:
                return min(1.0, float((-v[d < 0] / d[d < 0]).min(initial=1.0)))

            _, _, dz, ds = step(s * z)
            sigma = ((s + reach(s, ds) * ds) @ (z + reach(z, dz) * dz) / (s @ z)) ** 3
            dx, dy, dz, ds = step(s * z + ds * dz - sigma * mu)
        except np.linalg.LinAlgError:
            return None
        t = 0.99 * min(reach(s, ds), reach(z, dz))
        x, y, z, s = x + t * dx, y + t * dy, z + t * dz, s + t * ds
        if not np.isfinite(x).all() or t < 1e-9:
            return None
    return None


def interior_point(p: np.ndarray, c: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """``descend`` on plain matrices."""
    return descend(Dense(p, g, a), c, h, b)


@dataclass(frozen=True)
class Factored:
    """A covariance L L' + diag(own)."""

    load: np.ndarray
    own: np.ndarray


def factored(cov: np.ndarray) -> Factored:
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return Factored(vectors * np.sqrt(np.maximum(values, 0)), np.zeros(len(cov)))


@dataclass(frozen=True)
class Limits:
    upper: float = 0.1
    style: float = 0.3
    industry: float = 0.1
    turnover: float = 0.9
    risk: float = 1.0  # weight of variance (methods 2 to 4), or 1 / of return (method 1)
    trade: float = 0.01  # weight of traded volume
    exposure: float = 0.1  # weight of squared style exposure (method 3)
    misaligned: float = 0.1  # weight of the return outside the styles (method 4)


@dataclass(frozen=True)
class Day:
    """One date's names: expected returns, covariance, style exposures, industry dummies, benchmark and previous weights."""

    alpha: np.ndarray
    cov: np.ndarray | Factored
    style: np.ndarray
    industry: np.ndarray
    bench: np.ndarray
    prev: np.ndarray | None


def bands(day: Day, limits: Limits, use_style: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Exposure bands around the benchmark, as rows of G and entries of h."""
    rows, right = [], []
    for x, width in ((day.style, limits.style), (day.industry, limits.industry)):
        if x.shape[1] and (use_style or x is not day.style):
            at = x.T @ day.bench
            rows += [x.T, -x.T]
            right += [at + width, width - at]
    return rows, right


def problem(day: Day, limits: Limits, method: int) -> np.ndarray | None:
    """Weights of one date, or None. Method 1: a turnover limit. 2: a price on turnover. 3: on style exposure too. 4: on misalignment instead."""
    n = len(day.alpha)
    rows, right = bands(day, limits, method != 3)
    cov = day.cov if isinstance(day.cov, Factored) else factored(day.cov)
    scale, lin = (2.0, -day.alpha / max(limits.risk, 1e-6)) if method == 1 else (2.0 * limits.risk, -day.alpha)
    load = [np.sqrt(scale) * cov.load]
    if method == 3:
        load.append(np.sqrt(2 * limits.exposure) * day.style)
    if method == 4:
        rest = day.alpha - day.style @ (np.linalg.pinv(day.style) @ day.alpha) if day.style.shape[1] else day.alpha
        load.append(np.sqrt(2 * limits.misaligned) * rest[:, None])
    traded = day.prev is not None and day.prev.sum() > 1e-9
    width = 2 * n if traded else n
    g, h, c = [np.hstack([r, np.zeros((len(r), width - n))]) for r in rows], list(right), np.zeros(width)
    c[:n] = lin
    more = []
    if traded:  # y >= |x - prev|
        more = [day.prev, -day.prev]
        if method == 1:
            g.append(np.hstack([np.zeros((1, n)), np.ones((1, n))]))
            h.append(np.array([limits.turnover - (1 - day.prev.sum())]))
        else:
            c[n:] = limits.trade
    dense = np.vstack(g) if g else np.zeros((0, width))
    x = descend(Portfolio(scale * cov.own, np.hstack(load), dense, traded), c, np.concatenate([*h, np.zeros(n), np.full(n, limits.upper), *more]), np.ones(1))
    return None if x is None else x[:n]


def beyond_turnover(day: Day, limits: Limits) -> bool:
    """Whether no weights at all are within the turnover limit (method 1), by more than the solver's tolerance of each constraint: the bands don't matter then.

    Previous weights above ``upper`` have to be sold, and what the others lack to 1, or have too much, is traded too.
    """
    if day.prev is None or day.prev.sum() <= 1e-9:
        return False
    kept = np.minimum(day.prev, limits.upper)
    least = (day.prev - kept).sum() + abs(1 - kept.sum())
    return least - (limits.turnover - (1 - day.prev.sum())) > 4e-6 * (len(day.prev) + 1)


def relaxed(day: Day, limits: Limits, method: int, solve: Callable = problem) -> tuple[np.ndarray, str]:
    """Weights, and which limits had to give: styles by 0.1 up to 1, then industries by 0.05 up to 1, then turnover by 0.1 up to 2."""
    base, note = limits, "none"
    while True:
        x = None if method == 1 and solve is problem and beyond_turnover(day, limits) else solve(day, limits, method)
        if x is not None:
            break
        if limits.style < 1:
            limits, note = replace(limits, style=round(limits.style + 0.1, 10)), "style"
        elif limits.industry < 1:
            limits, note = replace(limits, style=base.style, industry=round(limits.industry + 0.05, 10)), "industry"
            if limits.industry < 1:
                limits = replace(limits, style=1.0)  # styles have been tried at this step
        elif limits.turnover < 2 and method == 1:
            limits, note = replace(base, style=1.0, industry=1.0, turnover=round(limits.turnover + 0.1, 10)), "turnover"
        else:
            x, note = day.bench, "gave up"
            break
    x = np.maximum(x, 0)
    return x / x.sum() if x.sum() > 0 else day.bench, note


def weights(cells: DataFrame, covariance: DataFrame, styles: list[str], group: str, scenarios: list[tuple[int, int, float, float]], skip: int = 3, floor: float = 1e-6) -> DataFrame:
    """(scenario, trade_date, ticker, w, relaxed) for scenarios (id, method, style limit, turnover limit).

    cells: trade_date, ticker, alpha, idio (variance), industry, bench and styles; covariance: trade_date,
    i, j, value of the styles and of the industries as ``group``_k. A date's asset covariance is X F X' +
    diag(idio). A scenario's days depend on each other, so each scenario is one task; its rows come sorted
    by date, a date's covariance before its names, and it holds one date at a time.
    """
    spark = cells.sparkSession
    grid = F.broadcast(spark.createDataFrame(scenarios, "scenario int, method int, style_limit double, turnover_limit double"))
    fields = ["ticker", "alpha", "idio", "industry", "bench", *styles]

    def solved(d: pd.DataFrame, f: pd.DataFrame, limits: Limits, method: int, prev: pd.Series | None) -> tuple[np.ndarray, str]:
        x = d[styles].to_numpy(float)
        kinds = np.sort(d["industry"].unique())
        one = (d["industry"].to_numpy()[:, None] == kinds[None]).astype(float)
        names = [*styles, *[f"{group}_{int(k)}" for k in kinds]]
        f = f.pivot(index="i", columns="j", values="value").reindex(index=names, columns=names).fillna(0.0).to_numpy(float)
        sigma = Factored(*asset_factors(np.hstack([x, one]), f, d["idio"].to_numpy(float)))
        bench = d["bench"].to_numpy(float) / d["bench"].sum()
        old = None if prev is None else d["ticker"].map(prev).fillna(0.0).to_numpy()
        return relaxed(Day(d["alpha"].to_numpy(float), sigma, x, one, bench, old), replace(limits, upper=max(limits.upper, 3 / len(d), float(bench.max()))), method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scenario, k, prev = None, 0, None
        for d in by_keys(batches, ["scenario", "trade_date"]):
            if d["scenario"].iloc[0] != scenario:
                scenario, k, prev = d["scenario"].iloc[0], 0, None
            cov, d = d[d["is_name"] == 0], d[d["is_name"] == 1]
            d = d[["trade_date", *fields, "method", "style_limit", "turnover_limit"]].dropna()
            if not len(d):
                continue
            k += 1
            if k <= skip or len(d) < 5 or not len(cov):
                continue
            limits = Limits(style=float(d["style_limit"].iloc[0]), turnover=float(d["turnover_limit"].iloc[0]))
            w, note = solved(d, cov, limits, int(d["method"].iloc[0]), prev)
            w = np.where(w > floor, w, 0.0)
            prev = pd.Series(w, index=d["ticker"].to_numpy())
            yield pd.DataFrame({"scenario": int(scenario), "trade_date": d["trade_date"], "ticker": d["ticker"], "w": w, "relaxed": note})

    names = F.broadcast(spark.createDataFrame([(s[0],) for s in scenarios], "scenario int"))
    joined = cells.select("trade_date", *fields).crossJoin(grid).withColumn("is_name", F.lit(1))  # each scenario works on all cells
    covs = covariance.select("trade_date", "i", "j", "value").crossJoin(names).withColumn("is_name", F.lit(0))
    rows = joined.unionByName(covs, allowMissingColumns=True).repartition(16 * len(scenarios), "scenario").sortWithinPartitions("scenario", "trade_date", "is_name", "ticker")
    return rows.mapInPandas(run, "scenario int, trade_date date, ticker string, w double, relaxed string")


def by_keys(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, put together from batches of sorted rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for _, d in b.groupby(keys, sort=True, dropna=False):
            if held and any(held[-1][c].iloc[-1] != d[c].iloc[0] for c in keys):
                yield pd.concat(held)
                held = []
            held.append(d)
    if held:
        yield pd.concat(held)


def over_universe(weights_: DataFrame, panel: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """Weights of every ticker of the panel on the dates of each scenario, 0 where there is none; tickers of ``blacklist`` have 0 and the others are scaled up."""
    grid = weights_.select("scenario", "trade_date").distinct().crossJoin(F.broadcast(panel.select("ticker").distinct()))
    out = grid.join(weights_.select("scenario", "trade_date", "ticker", "w"), ["scenario", "trade_date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    if blacklist is None:
        return out
    out = out.join(F.broadcast(blacklist.select("ticker", F.lit(True).alias("barred"))), "ticker", "left").withColumn("w", F.when(F.col("barred"), 0.0).otherwise(F.col("w")))
    total = F.sum("w").over(Window.partitionBy("scenario", "trade_date"))
    return out.withColumn("w", F.coalesce(div("w", total), F.lit(0.0))).drop("barred")
