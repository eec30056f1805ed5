"""Records that are replaced by key.

Rows are dealt to buckets by the hash of their key. An upsert writes the buckets that it touches anew,
without the rows whose keys come again, into a folder of its own; then one small file that lists each
bucket's folder is put in place. Readers follow the latest such file, so an upsert that fails halfway
leaves everything as it was, and each bucket stays one folder without old rows. Of two writers at
once the second fails, and can try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Records:
    """A table under ``root`` with key columns ``keys``."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path("versions")
        names = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _listed(self, version: int) -> dict[str, str]:
        """Each bucket's folder."""
        (line,) = self.spark.read.text(f"{self.root.rstrip('/')}/versions/{version}.json", wholetext=True).collect()
        return json.loads(line[0])

    def _listing(self) -> tuple[int, dict[str, str]]:
        versions = self._versions()
        return (versions[-1], self._listed(versions[-1])) if versions else (0, {})

    def _commit(self, version: int, listing: dict[str, str]) -> None:
        files, own = self._files, self._path("versions", f"{uuid.uuid4().hex}.tmp")
        if not files.createNewFile(self._path("versions", f"{version}.taken")):
            raise RuntimeError(f"version {version} of {self.root} is being written by another upsert")
        out = files.create(own, True)
        out.write(bytearray(json.dumps(listing).encode()))
        out.close()
        files.rename(own, self._path("versions", f"{version}.json"))

    @property
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root.rstrip('/')}/{f}" for f in folders])

    def read(self) -> DataFrame:
        _, listing = self._listing()
        if not listing:
            raise FileNotFoundError(f"nothing was written to {self.root}")
        return self._read(sorted(listing.values()))

    def upsert(self, rows: DataFrame, latest: str | None = None) -> None:
        """Replace or add one row for each key. Where a key comes more than once, the row with the greatest ``latest`` stays; without that column it is an error. Null is a key like others."""
        by = Window.partitionBy(*self.keys)
        if latest:
            rows = rows.withColumn("_nth", F.row_number().over(by.orderBy(F.desc_nulls_last(latest)))).where("_nth = 1").drop("_nth")
        else:
            rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).where(F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("a key comes more than once:"), *[F.col(k).cast("string") for k in self.keys]))).otherwise(F.lit(True))).drop("_n")
        version, listing = self._listing()
        rows = rows.withColumn("_bucket", self.bucket)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # as many as there are buckets
        if not touched:
            return
        held = sorted(listing[str(b)] for b in touched if str(b) in listing)
        if held:
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys]
            old = self._read(held).alias("old").join(rows.select(*self.keys).alias("new"), same, "left_anti")
            rows = rows.unionByName(old.withColumn("_bucket", self.bucket), allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition("_bucket").withColumnRenamed("_bucket", "bucket").write.partitionBy("bucket").parquet(f"{self.root.rstrip('/')}/{folder}")
        self._commit(version + 1, listing | {str(b): f"{folder}/bucket={b}" for b in touched})

    def vacuum(self) -> None:
        """Delete the folders that neither the latest version nor the one before it lists; not while an upsert runs."""
        versions, data = self._versions()[-2:], self._path("data")
        used = {f.split("/")[1] for v in versions for f in self._listed(v).values()}
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            if s.getPath().getName() not in used:
                self._files.delete(s.getPath(), True)
