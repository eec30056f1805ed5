"""Results kept as partitioned Parquet: features, signals, returns, covariances, weights, industries, summaries.

Each kind of result has its key columns as partitions, so readers prune to the names and dates that
they ask for, and writing one name replaces that name only.
"""

from __future__ import annotations

import hashlib
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partition columns of each kind of result.
KINDS = {
    "feature": ("kind", "name"),
    "signal": ("name", "path_id"),
    "factor_return": ("ret_type",),
    "covariance": ("adj_chain", "ret_type", "month"),
    "covariance_dates": ("adj_chain", "ret_type"),
    "weights": ("scenario",),
    "dyn_industry": ("model_name",),
    "coefficient": ("name",),
    "summary": (),
    "windows": ("name",),
}


def results_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one named by spark.checkpoint.dir, or on this machine alone one of the session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        already = context._jsc.sc().getCheckpointDir()
        if already.isDefined():
            named = already.get()
        elif context.master == "local" or context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
            named = context._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share: results are written there.")
    return f"{named.rstrip('/')}/quantloom-{context.applicationId}"


def kept_in(spark: SparkSession, sf_dir: str) -> str:
    """A session's folder for what it derives from one folder of tables."""
    return f"{results_dir(spark)}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    kinds: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(KINDS))

    def path(self, what: str) -> str:
        if what not in self.kinds:
            raise ValueError(f"unknown kind {what}; known: {', '.join(self.kinds)}")
        return f"{self.root.rstrip('/')}/{what}"

    def write(self, what: str, df: DataFrame, **keys) -> None:
        """Replace the partitions that ``df`` (with ``keys`` added as columns) has rows of."""
        parts = self.kinds[what] if what in self.kinds else ()
        df = df.withColumns({k: F.lit(v) for k, v in keys.items()}) if keys else df
        missing = [c for c in parts if c not in df.columns]
        if missing:
            raise ValueError(f"{what} needs {', '.join(missing)}")
        if parts:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.path(what))
        else:
            df.write.mode("append").parquet(self.path(what))

    def read(self, what: str, dates: tuple[str, str] | None = None, **keys) -> DataFrame:
        """Rows of some partitions, and of a range of dates if there is one.

        Results of one kind may differ in their columns, so where the first partition columns are named, only their folder is read.
        """
        df = self.spark.read.option("basePath", self.path(what)).parquet(self.folder(what, **keys))
        for k, v in keys.items():
            df = df.where(F.col(k) == v)
        return df.where(F.col("trade_date").between(*dates)) if dates else df


    def asof(self, what: str, asked: DataFrame, **keys) -> DataFrame:
        """For each date of ``asked`` (asked_date) the rows of the last date on or before it, with asked_date; none where there is no such date.

        For kinds with a partition ``month``: the dates that there are come from the kind's index, so of the rows only the months that are met are read.
        """
        known = self.read(f"{what}_dates", **keys).select("trade_date", "month").distinct()
        both = asked.select(F.col("asked_date").alias("at")).where("at is not null").distinct().withColumns({"is_asked": F.lit(True), "trade_date": F.lit(None).cast("date"), "month": F.lit(None).cast("string")})
        both = both.unionByName(known.select(F.col("trade_date").alias("at"), F.lit(False).alias("is_asked"), "trade_date", "month"))
        back = Window.orderBy("at", "is_asked").rowsBetween(Window.unboundedPreceding, 0)  # a row for each date
        met = both.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in ("trade_date", "month")}).where("is_asked and trade_date is not null")
        met = met.select(F.col("at").alias("asked_date"), "trade_date", "month")
        return self.read(what, **keys).join(F.broadcast(met), ["month", "trade_date"]).drop("month")  # a row for each date

    def keep_dated(self, what: str, df: DataFrame, **keys) -> None:
        """Write rows with their month as a partition, and the dates that there are as an index beside them."""
        df = df.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
        self.write(what, df.repartition("month"), **keys)
        self.write(f"{what}_dates", self.read(what, **keys).select("trade_date", "month").distinct(), **keys)

    def has(self, what: str, **keys) -> bool:
        """Whether something of this kind, with these partitions, was written whole."""
        return self.exists("/".join([self.path(what), *[f"{k}={keys[k]}" for k in self.kinds[what] if k in keys]]))

    def exists(self, at: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def folder(self, what: str, **keys) -> str:
        """The deepest folder there is that has all rows of the partitions named by ``keys``."""
        at = self.path(what)
        for k in self.kinds[what]:
            if k not in keys or not self.exists(f"{at}/{k}={keys[k]}"):
                break
            at += f"/{k}={keys[k]}"
        return at


def require(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows of the tickers asked for; an unknown one is an error when the rows are read, as a look-up by label is."""
    wanted = tickers.select("ticker").distinct()
    known = df.select("ticker").distinct().withColumn("known", F.lit(True))
    checked = wanted.join(known, "ticker", "left").select(F.when(F.col("known"), F.col("ticker")).otherwise(F.raise_error(F.concat(F.lit("unknown ticker "), F.coalesce("ticker", F.lit("null"))))).alias("ticker"))
    return df.join(checked, "ticker", "left_semi")
