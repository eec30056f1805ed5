"""Shared helpers: tables in the cluster's shared folder, and the training folds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set as the session's checkpoint folder.

    A session on this machine alone that names none gets a folder of its own; on a cluster that is an
    error, since executors don't share a machine's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    already = context._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and the rows survive lost executors.

    The folder is in the attribute ``written_to`` of the result, for ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quantloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Delete the folders of written tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "written_to", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Hand the memory back that earlier tasks of this worker process have freed."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps no such memory
        pass


_HELD: dict = {}


def held(key: object, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks: one operator's model or cache at a time, whatever ran there before."""
    if _HELD.get("key") != key:
        _HELD.clear()
        trim()  # before the next model takes memory
        _HELD.update(key=key, value=make())
        trim()  # what only its making needed
    return _HELD["value"]


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
