"""Queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.panel import DAY_SQL, MONTH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, day: bool = False, month: bool = True):
    """Register a function (spark, sf_dir) under a name, with SQL over the panels if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [MONTH_SQL] * month + [DAY_SQL] * day
            text = sql.strip()
            if parts:
                more = text[4:].lstrip() if text.lower().startswith("with") else None
                text = "with " + ",".join(parts) + (", " + more if more else "\n" + text)
            ORACLES[name] = text
        return f

    return add


def r(x: str) -> str:
    return f"round(({x}) + 1e-9, 6)"


def roll(agg: str, x: str, n: int, least: int | None = None, key: str = "ticker") -> str:
    w = f"over (partition by {key} order by date_idx rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} >= {n if least is None else least} then {agg.format(x)} {w} end"


def corr(x: str, y: str) -> str:
    a, b = (f"case when {x} is not null and {y} is not null then {v} end" for v in (x, y))
    return f"case when stddev_pop({a}) > 1e-12 and stddev_pop({b}) > 1e-12 then covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end"


def pct(x: str, p: float, over: str = "partition by trade_date") -> str:
    return f"quantile_cont({x}, {p}) over ({over})"


def avg_rank(x: str, descending: bool = False) -> str:
    return f"case when {x} is not null then rank() over (partition by trade_date order by {x} {'desc' if descending else 'asc'} nulls last) + (count(*) over (partition by trade_date, {x}) - 1) / 2.0 end"
