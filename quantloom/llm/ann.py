"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length 1, rotated at random, and kept as the signs of its coordinates,
packed to bits, with one correction scalar: its inner product with the code. The rotated query is
rounded to PLANES bits a coordinate, one packed plane for each, so that <query, code> is a weighted sum
of the counts of common bits of the planes and the code. <query, row> is estimated as <query, code> /
<code, row>; the error is at most ``epsilon`` * sqrt((1 - c*c) / (c*c) / (dim - 1)), with c that scalar,
but for a small share of the pairs, and what the rounding adds. A row is reranked with the original
vectors if its estimate plus error reaches the k-th best value known so far. Queries and rows meet in
blocks of bounded size, and each block gives k rows a query, so a query's final k come from a few rows
per block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, as query or as candidate; vectors meet only vectors of their own length; ties go to the smaller
id; rows that repeat an id are rows of their own, each of which is ranked and is a candidate of the
others; an empty table gives an empty result; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import clean, embeddings, matrix, spread, units

TOP = 5
EPSILON = 2.6  # width of the error bound: higher finds more and reranks more
PLANES = 8  # bits of a query's coordinates
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
MARGIN = 1e-12  # by which fast products of unit vectors may be off
FIRST = 32  # rows reranked first, for the value that the others have to reach


def encode(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated rows, and their inner products with those codes."""
    rotated = units(m) @ spread(m.shape[1], m.shape[1]).T
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(m.shape[1])


def coded(rows: DataFrame) -> DataFrame:
    """row, id, v, dim with bits and scalar: the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                bits, scalar = encode(matrix(part["v"]))
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "dim": dim, "bits": [x.tobytes() for x in bits], "scalar": scalar})

    return rows.mapInPandas(run, "id long, v array<double>, dim int, bits binary, scalar double").withColumn("row", F.monotonically_increasing_id())


def wide(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, one array for each word."""
    words = -(-bits.shape[-1] // 8)
    return np.ascontiguousarray(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, 8 * words - bits.shape[-1])])).view("u8")


class Planes:
    """Rotated queries, rounded to PLANES bits and packed."""

    def __init__(self, rotated: np.ndarray):
        self.dim = rotated.shape[1]
        self.low = rotated.min(axis=1)
        self.step = np.maximum(rotated.max(axis=1) - self.low, 1e-30) / (2**PLANES - 1)
        levels = np.rint((rotated - self.low[:, None]) / self.step[:, None]).astype("i8")
        self.total = self.low * self.dim + self.step * levels.sum(axis=1)
        self.words = [wide(np.packbits((levels >> j) & 1 == 1, axis=1)) for j in range(PLANES)]

    def products(self, i: int, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """<query i, code> with each of the codes (words, rows), of which ``ones`` bits are set."""
        common = np.zeros(code.shape[1], "i8")
        for j in range(PLANES):
            for k, word in enumerate(code):
                common += np.bitwise_count(word & self.words[j][i, k]).astype("i8") << j
        under_ones = self.low[i] * ones + self.step[i] * common  # the query's coordinates where the code is 1
        return (2 * under_ones - self.total[i]) / np.sqrt(self.dim)

    def error(self) -> np.ndarray:
        """How far rounding may move the products of each query."""
        return self.step / 2 * np.sqrt(self.dim)


def nearest(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, bits: np.ndarray, scalar: np.ndarray, top: int, epsilon: float) -> list[tuple[int, int, int, float]]:
    """(query's row, row, id, score) of the best ``top`` rows of one block for each query of one block, by estimates and reranking."""
    dim = m.shape[1]
    code = np.ascontiguousarray(wide(bits).T)
    ones = np.bitwise_count(code).sum(axis=0, dtype="i8")
    error = epsilon * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(dim - 1, 1))
    unit, queries = units(m), units(q)
    planes = Planes(queries @ spread(dim, dim).T)
    rounding = planes.error()
    norms, q_norms = np.sqrt(np.einsum("ij,ij->i", m, m)), np.sqrt(np.einsum("ij,ij->i", q, q))
    out = []
    for i in range(len(q)):
        near = planes.products(i, code, ones) / scalar
        near[rows == q_rows[i]] = -np.inf
        first = np.argpartition(-near, FIRST)[:FIRST] if len(near) > FIRST else np.arange(len(near))
        exact = unit[first] @ queries[i]
        reach = np.sort(exact[near[first] > -np.inf])[::-1][:top]
        reach = reach[-1] if len(reach) == top else -np.inf
        chosen = np.flatnonzero((near + error + rounding[i] / scalar >= reach - 1e-9) & (near > -np.inf))
        close = unit[chosen] @ queries[i]
        keep = chosen[close >= np.sort(close)[-top:].min(initial=np.inf) - MARGIN]  # all near ties, put in order below
        dots = np.einsum("ij,j->i", m[keep], q[i])
        with np.errstate(all="ignore"):
            score = dots / (norms[keep] * q_norms[i])
        score = np.where(np.isfinite(score), score, unit[keep] @ queries[i])
        order = np.lexsort((ids[keep], -score))[:top]
        out += [(int(q_rows[i]), int(rows[keep[o]]), int(ids[keep[o]]), float(score[o])) for o in order]
    return out


def search(vectors: DataFrame, is_query: str, top: int = TOP, epsilon: float = EPSILON, key: str = "vec_id", col: str = "embedding", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows found for each row with ``is_query`` (of ``id``)."""
    spark = vectors.sparkSession
    index = written(coded(clean(vectors, key, col)), "codes")
    sizes = {(r["dim"], r["q"]): r["n"] for r in index.groupBy("dim", F.expr(is_query).alias("q")).agg(F.count("*").alias("n")).collect()}  # two rows for each length
    dims = sorted({d for d, _ in sizes})
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = {d: (-(-sum(n for (e, _), n in sizes.items() if e == d) // row_block), max(1, -(-sizes.get((d, True), 0) // query_block))) for d in dims}
    n_rows = "case dim " + " ".join(f"when {d} then {b[0]}" for d, b in blocks.items()) + " end"
    n_queries = "case dim " + " ".join(f"when {d} then {b[1]}" for d, b in blocks.items()) + " end"
    # A row goes to one block and meets each block of queries; a query the other way round.
    rows = index.withColumn("rb", F.expr(f"cast(pmod(xxhash64(row), {n_rows}) as int)")).withColumn("qb", F.expr(f"explode(sequence(0, {n_queries} - 1))"))
    queries = index.where(is_query).select("row", "id", "v", "dim").withColumn("qb", F.expr(f"cast(pmod(xxhash64(row, 1), {n_queries}) as int)")).withColumn("rb", F.expr(f"explode(sequence(0, {n_rows} - 1))"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, float]] = []
        if len(left) and len(right):
            bits = np.stack([np.frombuffer(x, "u1") for x in right["bits"]])
            found = nearest(left["row"].to_numpy(), matrix(left["v"]), right["row"].to_numpy(), right["id"].to_numpy(), matrix(right["v"]), bits, right["scalar"].to_numpy(), top, epsilon)
        got = pd.DataFrame(found, columns=["query", "row", "vec_id", "score"]).astype({"query": "i8", "row": "i8", "vec_id": "i8", "score": "f8"})
        return got.assign(query_id=got["query"].map(dict(zip(left["row"], left["id"], strict=True))).astype("i8") if len(got) else got["query"])

    by = ["dim", "qb", "rb"]
    found = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(meet, "query long, row long, vec_id long, score double, query_id long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {top}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows, by cosine, of every row whose vec_id is divisible by 50."""
    return search(embeddings(spark, sf_dir), "id % 50 = 0")
