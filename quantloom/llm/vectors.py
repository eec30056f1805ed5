"""Reading embedding columns: which vectors count, and as what matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(col: str) -> Column:
    """The vector is there, isn't zero, and has finite components only."""
    v = F.col(col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(col).isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def clean(vectors: DataFrame, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """key, v (doubles) and dim of the vectors that count."""
    return vectors.where(F.col(key).isNotNull() & usable(col)).select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"), F.size(col).alias("dim"))


def matrix(col: pd.Series) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.stack(list(col)).astype("f8", copy=False) if len(col) else np.zeros((0, 0))


def units(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small components."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def spread(dim: int, rank: int, seed: int = 7) -> np.ndarray:
    """A random rotation of ``dim`` dimensions (its first ``rank`` rows)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).T[:rank]
