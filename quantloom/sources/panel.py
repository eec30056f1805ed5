"""Long panels (ticker, trade_date, date_idx, fields) from tables, dense on calendar x tickers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import by_ticker, div


PART_LINES = 2_000_000  # lines that a task sorts, about 300 bytes each


@dataclass(frozen=True)
class PanelSchema:
    """Columns that a panel has to have, checked when it is loaded."""

    required: tuple[str, ...] = ("ticker", "trade_date", "date_idx")
    fields: tuple[str, ...] = ("open", "high", "low", "close", "vwap", "volume", "value")

    def check(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (*self.required, *self.fields) if c not in df.columns]
        if missing:
            raise ValueError(f"panel lacks {', '.join(missing)}")
        return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(dates: DataFrame, col: str = "trade_date") -> DataFrame:
    """Distinct dates with their index from 0; a calendar has one row per date, so one task orders it."""
    return dates.select(F.col(col).alias("trade_date")).where("trade_date is not null").distinct().withColumn("date_idx", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("int"))


def dense(cells: DataFrame, cal: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row for each date and ticker; cells that aren't there are null."""
    spine = tickers.select("ticker").distinct().crossJoin(F.broadcast(cal))
    return spine.join(cells, ["ticker", "trade_date"], "left")


def exact_sum(x: str) -> Column:
    """A sum that doesn't hang on the order of rows, so that equal rows give equal sums: by decimals to 8 places; what has none (infinite, not a number, from 1e20) is added as doubles."""
    exact = F.col(x).try_cast("decimal(28,8)")
    whole, rest = F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), F.col(x)))
    return F.coalesce(whole + rest, whole, rest)


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` by ``key``, in as many partitions as ``n`` rows ask for, so that a task's memory doesn't grow with them; the session's number where that is enough."""
    parts = -(-n // PART_LINES)
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def month_cells(lineitem: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Supplier-month bars of unit prices; with ``cal``, a row for each ticker and date of it, null where there are no lines.

    Lines are dealt by ticker as they are, which is less to move than sums that hold a line or two each, and all
    that follows by ticker finds them there. A ticker's dates come as rows without a line, so nothing is joined.
    """
    line = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = lineitem.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ticker"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("trade_date"), *line, F.lit(True).alias("is_line"))
    rows = lines
    if cal is not None:
        spine = lines.select("ticker").distinct().crossJoin(F.broadcast(cal.select("trade_date")))
        rows = lines.where("ticker is not null and trade_date is not null").unionByName(spine, allowMissingColumns=True)
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.when(F.col("is_line"), F.struct(*line))
    return (
        dealt(rows, "ticker", lineitem.count())
        .groupBy("ticker", "trade_date")
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            (exact_sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
            F.sum("l_quantity").alias("volume"),
            exact_sum("l_extendedprice").alias("value"),
        )
    )


_PANELS: dict[tuple[str, str, str], DataFrame] = {}


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly supplier panel with turnover, cap (trailing value), previous close, returns, industry and region.

    Cached for the session, partitioned by ticker: all time-series windows share that one exchange.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "month")
    if key not in _PANELS:
        lines = table(spark, sf_dir, "lineitem")
        cal = calendar(lines.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("trade_date")))  # one column is scanned, not all that cells need
        supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
        static = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ticker"), F.col("s_nationkey").cast("int").alias("industry"), F.col("n_regionkey").cast("int").alias("region")
        )
        panel = month_cells(lines, cal).join(F.broadcast(cal), "trade_date").join(static, "ticker", "left")
        panel = panel.withColumns(
            {
                "preclose": F.lag("close").over(by_ticker()),
                "cap": F.sum("value").over(by_ticker().rowsBetween(-11, 0)),
                "turnover": div("volume", F.sum("volume").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))),
            }
        )
        panel = panel.withColumn("ret", div("close", "preclose") - 1)
        _PANELS[key] = PanelSchema().check(panel).cache()  # dealt by ticker and sorted by date for its own windows
    return _PANELS[key]


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily user bars of event values; a tenth of the cells has no events."""
    key = (spark.sparkContext.applicationId, sf_dir, "day")
    if key not in _PANELS:
        order = F.struct("ts", "event_id")
        cells = (
            table(spark, sf_dir, "events")
            .withColumn("ticker", F.lpad(F.col("user_id").cast("string"), 6, "0"))
            .withColumn("trade_date", F.to_date("ts"))
            .groupBy("ticker", "trade_date")
            .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.avg("value").alias("vwap"), F.count("value").cast("double").alias("volume"), F.sum("value").alias("value"))
        )
        _PANELS[key] = PanelSchema().check(dense(cells, calendar(cells), cells.select("ticker"))).cache()
    return _PANELS[key]


#: The same panels for the SQL engine that checks results.
MONTH_SQL = """
cells as (select lpad(cast(l_suppkey as varchar), 6, '0') as ticker, cast(date_trunc('month', l_shipdate) as date) as trade_date,
  first(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as open,
  max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
  last(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as close,
  sum(l_extendedprice) / sum(l_quantity) as vwap, sum(l_quantity) as volume, sum(l_extendedprice) as value
  from lineitem group by all),
cal as (select trade_date, cast(row_number() over (order by trade_date) - 1 as integer) as date_idx from (select distinct trade_date from cells)),
tickers as (select distinct ticker from cells),
static as (select lpad(cast(s_suppkey as varchar), 6, '0') as ticker, s_nationkey as industry, n_regionkey as region from supplier join nation on s_nationkey = n_nationkey),
base as (select t.ticker, c.trade_date, c.date_idx, open, high, low, close, vwap, volume, value, industry, region,
  lag(close) over w as preclose,
  sum(value) over (partition by t.ticker order by c.date_idx rows between 11 preceding and current row) as cap,
  volume / nullif(sum(volume) over (partition by t.ticker order by c.date_idx rows between unbounded preceding and current row), 0) as turnover
  from tickers t cross join cal c left join cells x on x.ticker = t.ticker and x.trade_date = c.trade_date left join static s on s.ticker = t.ticker
  window w as (partition by t.ticker order by c.date_idx)),
panel as (select *, close / nullif(preclose, 0) - 1 as ret from base)"""

DAY_SQL = """
dcells as (select lpad(cast(user_id as varchar), 6, '0') as ticker, cast(ts as date) as trade_date, first(value order by ts, event_id) as open, max(value) as high,
  min(value) as low, last(value order by ts, event_id) as close, avg(value) as vwap, cast(count(value) as double) as volume, sum(value) as value from events group by all),
dcal as (select trade_date, cast(row_number() over (order by trade_date) - 1 as integer) as date_idx from (select distinct trade_date from dcells)),
day as (select t.ticker, c.trade_date, c.date_idx, open, high, low, close, vwap, volume, value
  from (select distinct ticker from dcells) t cross join dcal c left join dcells x on x.ticker = t.ticker and x.trade_date = c.trade_date)"""
