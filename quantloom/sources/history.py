"""End-of-day histories of stocks, indices and funds, scanned by fields, dates and tickers.

A history is Parquet partitioned by source and year, each year's rows sorted by ticker and date. A
scan turns its arguments into what the reader can use: years of the range are partitions, so others
aren't listed; dates and tickers are filters on row groups; fields are the columns that are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import table

#: Fields of each source.
SOURCES: dict[str, tuple[str, ...]] = {
    "stock": ("open", "high", "low", "close", "preclose", "vwap", "volume", "value", "turnover", "cap"),
    "index": ("open", "high", "low", "close", "preclose", "volume", "value"),
    "fund": ("equity",),
}
KEYS = ("ticker", "trade_date")
LISTED = 10_000  # tickers that go into a filter; more come as a frame


@dataclass(frozen=True)
class History:
    spark: SparkSession
    root: str

    def path(self, source: str) -> str:
        if source not in SOURCES:
            raise ValueError(f"unknown source {source}; known: {', '.join(SOURCES)}")
        return f"{self.root.rstrip('/')}/history/source={source}"

    def written(self, source: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(source)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, source: str, df: DataFrame) -> None:
        """Replace the years that ``df`` (ticker, trade_date, fields) has rows of; a null ticker or date is no row of a history."""
        rows = df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in SOURCES[source]]).where("ticker is not null and trade_date is not null").withColumn("year", F.year("trade_date"))
        rows.repartitionByRange("year", "ticker").sortWithinPartitions("year", *KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(self.path(source))

    def scan(self, fields: Sequence[str] = (), tickers: Sequence[str] | DataFrame = (), start: str | None = None, end: str | None = None, source: str = "stock") -> DataFrame:
        """ticker, trade_date and ``fields`` from ``start`` to ``end``, both included; what isn't given is all there is.

        ``tickers``: a list, or a frame with a column ticker. Tickers without rows give none; unknown fields are an error.
        """
        known = SOURCES.get(source, ())
        unknown = [f for f in fields if f not in known]
        df = self.spark.read.parquet(self.path(source))
        if unknown:
            raise ValueError(f"{source} has no {', '.join(unknown)}; it has {', '.join(known)}")
        if start is not None:
            df = df.where((F.col("year") >= int(start[:4])) & (F.col("trade_date") >= F.lit(start).cast("date")))
        if end is not None:
            df = df.where((F.col("year") <= int(end[:4])) & (F.col("trade_date") <= F.lit(end).cast("date")))
        if isinstance(tickers, DataFrame):
            df = df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
        elif len(tickers) > LISTED:
            raise ValueError(f"{len(tickers)} tickers: give more than {LISTED} as a frame")
        elif tickers:
            df = df.where(F.col("ticker").isin(list(tickers)))
        return df.select(*KEYS, *(fields or known))


def index_cells(stocks: DataFrame, index: str = "region") -> DataFrame:
    """Bars of each index: its members' prices weighted by their value traded, and sums of volume and value."""
    prices = ("open", "high", "low", "close", "preclose")
    mean = [F.try_divide(F.sum(F.col(c) * F.col("value")), F.sum(F.when(F.col(c).isNotNull(), F.col("value")))).alias(c) for c in prices]
    return stocks.where(F.col(index).isNotNull()).groupBy(F.format_string("index%d", F.col(index)).alias("ticker"), "trade_date").agg(*mean, F.sum("volume").alias("volume"), F.sum("value").alias("value"))


def fund_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of a month as a fund's equity."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("ticker"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("trade_date")).agg(F.sum("o_totalprice").alias("equity"))
