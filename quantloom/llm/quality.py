"""Quality classifier: ridge regression on random Fourier features of document statistics.

The statistics of a whole text (shares of character classes, word and line lengths, repetition) are
standardised and mapped by random cosines, which approximate a Gaussian kernel. Every partition sums
its part of the normal equations; the driver adds the sums and solves for the ridge weights. Scores
are calibrated by isotonic regression on labelled rows that the weights were not fitted on.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; a document
with several labels counts with the largest; documents without label are scored only; if no label of
some class can be learnt from, all scores are the share of label 1 (0.5 without labels); an empty
table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, trim, written

FEATURES = 384  # random cosines
ROWS = 1000  # whose features are held at a time
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1e-3  # times the number of rows
FIT_ROWS = 200_000  # labelled rows used at most, by a hash of the id; their ids and labels are broadcast (5 MB)
FIT_PARTS = 16  # partitions that sum normal equations
CALIBRATION_BINS = 2000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "mark", "bang", "bar", "symbol", "bracket", "high"]
STATISTICS = [*CLASSES, "log_words", "word_len", "word_sd", "long", "single", "distinct", "pairs", "repeat", "top", "lines", "line_words", "same_lines", "odd_end", "caps"]


def byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("symbol"), "u1")
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r"), ("newline", b"\n"), ("stop", b"."), ("mark", b",;:'\"-?"), ("bang", b"!"), ("bar", b"|"), ("bracket", b"()[]{}<>"), ("high", range(128, 256))):
        table[list(chars)] = CLASSES.index(name)
    return table


TABLE = byte_classes()


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each whole text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "replace"), "u1")
        counts = np.bincount(TABLE[raw], minlength=len(CLASSES))
        row[: len(CLASSES)] = np.sqrt(counts / len(raw))
        words = text.split()
        n = len(words)
        if not n:
            continue
        lengths = np.fromiter(map(len, words), "i4", n)
        kinds = Counter(words)
        lines = [x for x in text.split("\n") if x]
        row[len(CLASSES) :] = (
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            (lengths > 14).mean(),
            (lengths == 1).mean(),
            len(kinds) / n**0.8,
            len(set(zip(words, words[1:]))) / n,
            sum(map(eq, words, words[1:])) / n,
            np.log1p(max(kinds.values()) / n * 100),
            np.log1p(len(lines)),
            np.log1p(n / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)),
            sum(not w[-1].isalnum() for w in kinds) / len(kinds),
            sum(w.isupper() for w in kinds) / len(kinds),
        )
    return out


def with_statistics(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, y and x, the statistics of the text, of the documents in ``marked`` (doc_id, y)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(statistics(b["text"].fillna("").tolist()).astype("f4"))})
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(marked), "doc_id").mapInPandas(run, "doc_id long, y double, x array<float>")


def bounded(labels: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id and y of labelled documents, ``most`` of them in expectation at most, by a hash of the id."""
    marked = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    share = min(1.0, most / max(1, marked.count()))
    return marked.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


class Cosines:
    """Standardising and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), n)) / width
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z / 6, np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])


def normal_equations(rows: DataFrame, features: Callable[[np.ndarray], np.ndarray], parts: int = FIT_PARTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all rows (x, y) of z z', z y and 1; each partition gives one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        a, b, n = 0.0, 0.0, 0
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                z = features(np.stack(list(part["x"])).astype("f8"))
                a, b, n = a + z.T @ z, b + z.T @ part["y"].to_numpy("f8"), n + len(part)
        if n:
            yield pd.DataFrame({"a": [np.ascontiguousarray(a).tobytes()], "b": [np.ascontiguousarray(b).tobytes()], "n": [n]})

    sums = rows.select("x", "y").coalesce(parts).mapInPandas(run, "a binary, b binary, n long").collect()  # a row for each of the few partitions
    b = sum(np.frombuffer(r["b"]) for r in sums)
    return sum(np.frombuffer(r["a"]) for r in sums).reshape(len(b), len(b)), b, sum(r["n"] for r in sums)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The increasing step function of least squared error: middles of its steps, and their values."""
    blocks: list[list[float]] = []  # value, weight, weighted x
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([b, w, a * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, s = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w2) / (u[1] + w2), u[1] + w2, u[2] + s
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    """Ridge weights on cosines, and the calibration of their scores; or a constant."""

    def __init__(self, constant: float | None = None, features: Cosines | None = None, weights: np.ndarray | None = None):
        self.constant, self.features, self.weights = constant, features, weights
        self.at, self.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.concatenate([np.zeros(0), *(self.features(x[i : i + ROWS]) @ self.weights for i in range(0, len(x), ROWS))])

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return r if self.constant is not None else np.clip(np.interp(r, self.at, self.value), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the texts of the documents that ``labels`` (doc_id, y) marks."""
    rows = with_statistics(docs, bounded(labels, fit_rows, 3))
    rows = written(rows.withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0), "labelled")
    dims = range(len(STATISTICS))
    got = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.array(*[F.avg(F.col("x")[i]) for i in dims]).alias("mean"), F.array(*[F.stddev_pop(F.col("x")[i]) for i in dims]).alias("sd")).first()
    if not got["n"] or got["y"] in (0, 1):
        return Model(constant=float(0.5 if got["y"] is None else got["y"]))
    sd = np.array(got["sd"])
    features = Cosines(np.array(got["mean"]), np.where(sd > 1e-9, sd, 1.0))
    a, b, n = normal_equations(rows.where("not later"), features)
    if not n:
        return Model(constant=float(got["y"]))
    model = Model(features=features, weights=np.linalg.solve(a + RIDGE * n * np.diag(np.r_[1e-6, np.full(len(b) - 1, 1.0)]) / 100, b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"r": model.raw(np.stack(list(batch["x"])).astype("f8")), "y": batch["y"]})

    r = rows.where("later").select("x", "y").mapInPandas(run, "r double, y double")
    bins = r.groupBy(F.floor(F.least(F.greatest("r", F.lit(-1.0)), F.lit(2.0)) * (CALIBRATION_BINS // 3)).alias("bin")).agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()  # CALIBRATION_BINS rows at most
    if bins:
        x, y, w = (np.array([b[k] for b in bins], "f8") for k in ("r", "y", "n"))
        model.at, model.value = isotonic(x, y, w)
    return model


def scorer(model: Model) -> Callable[[Column], Column]:
    """The score as a function of the text column; other columns stay where they are."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(statistics(t.fillna("").tolist()).astype("f4").astype("f8")), dtype="f8")
        trim()  # what follows may need the memory for other work than Python's

    return lambda text: score(text.cast("string"))


def training_labels(spark: SparkSession, sf_dir: str, kind: str, parts: int, left_out: int) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(fold("doc_id", parts) != left_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(kind).alias("y"))


def quality(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1."""
    return docs.withColumn(name, scorer(fit(docs, labels))(F.col("text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of all documents."""
    got = quality(documents(spark, sf_dir).select("doc_id", "text"), training_labels(spark, sf_dir, "quality", FOLDS, HELD_OUT))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
