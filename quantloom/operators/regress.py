"""Cross-sectional regressions, one kernel call per date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """(Weighted) least squares by the pseudo-inverse, so that rank-deficient designs are fine."""
    s = np.ones(len(y)) if w is None else np.sqrt(w)
    return np.linalg.pinv(x * s[:, None]) @ (y * s)


def design(pdf: pd.DataFrame, factors: list[str], group: str | None) -> tuple[np.ndarray, list[str]]:
    parts, names = [pdf[factors].to_numpy(float)], list(factors)
    if group:
        kinds = np.sort(pdf[group].dropna().unique())
        parts.append((pdf[group].to_numpy()[:, None] == kinds[None]).astype(float))
        names += [f"{group}_{int(k)}" for k in kinds]
    return np.hstack(parts), names


def factor_returns(panel: DataFrame, ret: str, factors: list[str], group: str | None = None, weight: str | None = None) -> DataFrame:
    """(trade_date, kind, name, value): 'factor' rows with the date's coefficients, 'idio' rows with each ticker's residual."""
    cols = list(dict.fromkeys(["trade_date", "ticker", ret, *factors, *([group] if group else []), *([weight] if weight else [])]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna()
        if weight:
            d = d[d[weight] > 0]
        if len(d) < 2:
            return pd.DataFrame(columns=["trade_date", "kind", "name", "value"], dtype=object)
        x, names = design(d, factors, group)
        y = d[ret].to_numpy(float)
        b = solve(x, y, d[weight].to_numpy(float) if weight else None)
        day = d["trade_date"].iloc[0]
        return pd.concat([pd.DataFrame({"trade_date": day, "kind": "factor", "name": names, "value": b}), pd.DataFrame({"trade_date": day, "kind": "idio", "name": d["ticker"], "value": y - x @ b})])

    return panel.select(*cols).groupBy("trade_date").applyInPandas(run, "trade_date date, kind string, name string, value double")


def membership(tickers: DataFrame, group: str, unknown: str = "100000") -> DataFrame:
    """(ticker, class_code, member 0 or 1): the matrix of tickers by classes, with a class for those without one. ``tickers``: a row for each, with its class."""
    own = tickers.select("ticker", F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("own"))
    classes = own.select(F.col("own").alias("class_code")).unionByName(own.sparkSession.range(1).select(F.lit(unknown).alias("class_code"))).distinct()
    return own.crossJoin(F.broadcast(classes)).select("ticker", "class_code", (F.col("own") == F.col("class_code")).cast("int").alias("member"))  # as many classes as industries


def two_step(panel: DataFrame, ret: str, factors: list[str], group: str, plate: str) -> DataFrame:
    """Fitted values of ret on groups and factors, and of the residual on plates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna()
        if len(d) < 2:
            return pd.DataFrame(columns=["trade_date", "ticker", "fitted", "plate_fit"], dtype=object)
        x, _ = design(d, factors, group)
        y = d[ret].to_numpy(float)
        fitted = x @ solve(x, y)
        rest = pd.Series(y - fitted, index=d.index)
        return pd.DataFrame({"trade_date": d["trade_date"], "ticker": d["ticker"], "fitted": fitted, "plate_fit": rest.groupby(d[plate]).transform("mean")})

    return panel.select("trade_date", "ticker", ret, *factors, group, plate).groupBy("trade_date").applyInPandas(run, "trade_date date, ticker string, fitted double, plate_fit double")
