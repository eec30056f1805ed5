"""Column expressions of panel algebra: null-safe arithmetic, rolling windows, ranks, moments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    """A ticker's dates in order. Windows and columns are made on call: importing needs no session."""
    return Window.partitionBy("ticker").orderBy("date_idx")


def by_date() -> WindowSpec:
    """The cross-section of a date."""
    return Window.partitionBy("trade_date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def masked(x: str | Column, mask: str | Column) -> Column:
    """x where the mask has a value (the add-back x + (y - y))."""
    return F.when(col(mask).isNotNull(), col(x))


def r6(x: str | Column) -> Column:
    """Rounded to six places, with a nudge off exact ties, so that engines agree."""
    return F.round(col(x) + F.lit(1e-9), 6)


def lag(x: str | Column, n: int = 1) -> Column:
    """The value n dates back; negative n looks forward."""
    return F.lag(col(x), n).over(by_ticker()) if n >= 0 else F.lead(col(x), -n).over(by_ticker())


def rows(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    """agg over the last n dates of a ticker; null unless ``least`` (all n) of them have a value."""
    w = rows(n)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), agg(col(x)).over(w))


def decayed(over: WindowSpec, decay: float, *xs: Column) -> list[Column]:
    """Sums over an ordered frame, each row counting ``decay`` times the next one; nulls as 0.

    The frame's rows are folded from the oldest on, so that no power of ``decay`` over- or underflows, however long the calendar.
    """
    frame = F.collect_list(F.struct(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(xs)])).over(over)

    def fold(name: str) -> Column:
        return F.aggregate(frame, F.lit(0.0), lambda total, row: total * decay + row[name])

    return [fold(f"x{i}") for i in range(len(xs))]


def ew_kernel(x: str | Column, n: int, half_life: float) -> Column:
    """Exponentially weighted mean of the last n values, the latest weighing most; null unless all are there."""
    decay = 0.5 ** (1 / half_life)
    w = rows(n)
    return F.when(F.count(col(x)).over(w) == n, decayed(w, decay, col(x))[0] / sum(decay**j for j in range(n)))


def ffill(x: str | Column) -> Column:
    return F.last(col(x), ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: str | Column) -> Column:
    return F.first(col(x), ignorenulls=True).over(by_ticker().rowsBetween(0, Window.unboundedFollowing))


def rank_first(x: str, descending: bool = False, by: str = "trade_date") -> Column:
    """Rank of non-null values per date, ties in ticker order."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    return F.when(F.col(x).isNotNull(), F.row_number().over(Window.partitionBy(by).orderBy(order, "ticker"))).cast("long")


def rank_avg(x: str, descending: bool = False, by: str | list[str] = "trade_date") -> Column:
    """Rank of non-null values per date, ties sharing their mean rank."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    over = Window.partitionBy(by).orderBy(order)
    ties = F.count(F.lit(1)).over(over.rangeBetween(Window.currentRow, Window.currentRow))  # the same exchange and sort
    return F.when(F.col(x).isNotNull(), F.rank().over(over) + (ties - 1) / 2.0)


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    """Both, only where both have values."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of complete pairs; null where either is constant."""
    a, b = pair(col(x), col(y))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-12) & (sb > 1e-12), F.covar_pop(a, b) / (sa * sb))


def weighted_mean(x: str | Column, w: str | Column, over=None) -> Column:
    """Sum(w x) / sum(w) over values of x."""
    own = F.when(col(x).isNotNull(), col(w))
    top, low = F.sum(col(x) * own), F.sum(own)
    return div(top.over(over), low.over(over)) if over is not None else div(top, low)


def zscore(x: str, over: WindowSpec | None = None) -> Column:
    over = over or by_date()
    return div(F.col(x) - F.avg(x).over(over), F.stddev(x).over(over))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def with_date(df: DataFrame, *more: str, **aggs: Column) -> DataFrame:
    """``df`` with aggregates of each date (and of the columns ``more``): they are broadcast, a row for each date or group of it, so the rows stay where they are."""
    keys = ("trade_date", *more)
    per = df.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(*[a.alias(k) for k, a in aggs.items()])
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return df.join(F.broadcast(per), on, "left").drop(*[f"of_{k}" for k in keys])
