"""Correlation graphs of tickers, their filtering, spanning trees and clusterings."""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import results_dir


#: Tickers up to which a window's correlations are one matrix in a task; beyond it, blocks of tickers meet pairwise.
WHOLE = 2000


def block_size(n: int, few: int, most: int) -> int:
    """Rows of a block of n that meet pairwise: each row is sent to as many tasks as there are blocks, so from 10,000 rows on there are about 16, until a block has ``most``."""
    return few if n < 10_000 else min(most, max(2 * few, n // 16))


def correlations(panel: DataFrame, least: int, x: str = "ret", ranks: bool = False, block: int | None = None, beyond: float | None = None, tile: int = 500) -> DataFrame:
    """(a, b, n, rho) of ticker pairs a < b with at least ``least`` common dates; Spearman's on each ticker's average ranks if asked for.

    Each ticker is one row of its values by date. Blocks of tickers meet pairwise, as products of matrices. With ``beyond``, only pairs
    with |rho| above it become rows. A ticker goes to as many tasks as there are blocks, so of many tickers they are larger: a task
    holds two blocks' values, but a tile's correlations only.
    """
    own = panel.where(F.col(x).isNotNull()).groupBy("ticker").agg(F.collect_list("date_idx").alias("at"), F.collect_list(F.col(x).cast("double")).alias("x"))
    n = panel.select("ticker").distinct().count()
    blocks = max(1, -(-n // (block or block_size(n, 500, 8000))))
    left, right = block_pairs(own, "ticker", blocks)
    keys = ("lb", "rb")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("same", pa.bool_()), ("dates", pa.int32()), ("a", pa.list_(pa.string())), ("u", pa.binary()), ("b", pa.list_(pa.string())), ("v", pa.binary())])
        if not len(left) or not len(right):
            return schema.empty_table()
        at = [pc.list_flatten(t["at"]).to_numpy() for t in (left, right)]
        dates = np.unique(np.concatenate(at))

        def matrix(t: pa.Table, at: np.ndarray) -> tuple[list, bytes]:
            size, order = pc.list_value_length(t["at"]).to_numpy(), pc.sort_indices(t["ticker"])
            cells = np.repeat(np.arange(len(t)), size), np.searchsorted(dates, at)
            v = np.full((len(t), len(dates)), np.nan)
            v[cells] = pc.list_flatten(t["x"]).to_numpy()
            if ranks:
                v = pd.DataFrame(v).rank(axis=1).to_numpy()
            v -= (np.bincount(cells[0], v[cells], len(t)) / size)[:, None]  # centred, so that little cancels
            return [t["ticker"].take(order).to_pylist()], v[order.to_numpy()].tobytes()

        (a, u), (b, v) = matrix(left, at[0]), matrix(right, at[1])
        same = left["lb"][0].as_py() == left["rb"][0].as_py()
        return pa.table([pa.array([same]), pa.array([len(dates)], pa.int32()), pa.array(a), pa.array([u]), pa.array(b), pa.array([v])], schema=schema)

    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                same, dates = batch["same"][k].as_py(), batch["dates"][k].as_py()
                a, b = batch["a"][k].values, batch["b"][k].values
                u, v = (np.frombuffer(batch[c][k].as_buffer(), float).reshape(-1, dates) for c in "uv")
                for i in range(0, len(a), tile):
                    for j in range(i if same else 0, len(b), tile):
                        yield from pairs(a[i : i + tile], b[j : j + tile], u[i : i + tile], v[j : j + tile], same and i == j)

    def pairs(a: pa.Array, b: pa.Array, u: np.ndarray, v: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        ou, ov = (~np.isnan(u)).astype(float), (~np.isnan(v)).astype(float)
        u, v = np.nan_to_num(u), np.nan_to_num(v)
        n = ou @ ov.T
        with np.errstate(all="ignore"):
            su, sv = u @ ov.T / n, ou @ v.T / n
            cov, vu, vv = u @ v.T / n - su * sv, (u * u) @ ov.T / n - su * su, ou @ (v * v).T / n - sv * sv
            sd = np.sqrt(np.maximum(vu, 0)), np.sqrt(np.maximum(vv, 0))
            rho = np.where((sd[0] > 1e-12) & (sd[1] > 1e-12), cov / (sd[0] * sd[1]), np.nan)
            meets = n >= least
            if same:
                meets &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
            if beyond is not None:
                meets &= np.abs(rho) > beyond
        i, j = np.nonzero(meets)
        names = pa.concat_arrays([a, b])
        rank = np.empty(len(names), int)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        ends = i, j + len(a)
        turned = rank[ends[0]] > rank[ends[1]]
        low, high = np.where(turned, ends[1], ends[0]), np.where(turned, ends[0], ends[1])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(n[i, j].astype("i8")), pa.array(rho[i, j], from_pandas=True)], ["a", "b", "n", "rho"])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "same boolean, dates int, a array<string>, u binary, b array<string>, v binary")
    return met.mapInArrow(tiles, "a string, b string, n long, rho double")


#: Similarities of tickers by name: (panel, least) to (a, b, n, rho).
SIMILARITIES = {"pearson": lambda panel, least: correlations(panel, least), "spearman": lambda panel, least: correlations(panel, least, ranks=True)}


def edge_threshold(n_dates: int, tau: float = 3.0) -> float:
    return float(np.tanh(tau / np.sqrt(n_dates - 3)))


def asset_edges(pairs: DataFrame, n_dates: int, tau: float = 3.0) -> DataFrame:
    return pairs.where(F.abs("rho") > edge_threshold(n_dates, tau))


def gaps(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids of each run from ``starts`` as bytes, and the bytes' starts: a distance to the one before is as many 255 as it holds, then the rest."""
    far = np.diff(ids, prepend=0)
    far[starts] = ids[starts]
    more = far // 255
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = far - more * 255
    return out, np.r_[0, ends][starts]


def from_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int32)[steps < 255]


def two_hops(edges: DataFrame, n: int, block: int | None = None, tile: int = 2000, most: int = 2_000_000) -> DataFrame:
    """Pairs (node, reach) at distance two, of about n nodes.

    Nodes are numbered, their neighbours are bytes of distances between numbers. Two blocks of nodes meet over the nodes that both have near, as bits:
    the paths themselves are never rows, and what is found goes on as bits until it becomes rows. A node goes to as many tasks as there are blocks, so of many nodes they are larger.
    """
    edges = _kept(edges.where("a <> b").select("a", "b"))
    names = pa.array(sorted(r[0] for r in edges.select(F.explode(F.array("a", "b"))).distinct().collect()), pa.string())  # one for each node
    block = block or (2000 if n < 10_000 else 8000)
    blocks = max(1, -(-len(names) // block))

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[np.ndarray] = []

        def lists() -> pa.RecordBatch:
            a, b = np.concatenate(part, axis=1) if part else np.zeros((2, 0), np.int64)
            key = np.unique(np.r_[a * len(names) + b, b * len(names) + a])
            node, near = key // max(1, len(names)), key % max(1, len(names))
            at = _starts(node) if len(node) else node
            return pa.RecordBatch.from_arrays([pa.array(node[at].astype("i4")), pa.ListArray.from_arrays(pa.array(np.r_[at, len(node)].astype("i4")), pa.array(near.astype("i4")))], ["node", "near"])

        for batch in batches:
            part.append(np.stack([pc.index_in(batch[c], names).to_numpy().astype(np.int64) for c in "ab"]))
            if sum(x.shape[1] for x in part) >= most:
                yield lists()
                part = []
        yield lists()

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch[lo : lo + 500] for batch in batches for lo in range(0, len(batch), 500)):
            whole = [np.unique(x.values.to_numpy()) for x in part["near"]]
            if whole:
                data, at = gaps(np.concatenate(whole).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in whole])[:-1]])
                near = [data[lo:hi].tobytes() for lo, hi in zip(at, [*at[1:], len(data)], strict=True)]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(near, pa.binary())], ["node", "near"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int32()), ("rb", pa.int32()), ("far", pa.binary())])
        if not len(left) or not len(right):
            return schema.empty_table()
        rb = right["rb"][0].as_py()
        first, width = rb * block, min(block, len(names) - rb * block)
        nodes, near = left["node"].to_numpy(), [from_gaps(x.as_buffer()) for x in left["near"]]
        by_node = dict(zip(right["node"].to_pylist(), right["near"], strict=True))
        far = np.zeros((len(nodes), -(-width // 8)), np.uint8)
        for lo in range(0, width, tile):
            size = min(tile, width - lo)
            bits = np.zeros((len(names), -(-size // 8)), np.uint8)
            for k in range(size):
                if (x := by_node.get(first + lo + k)) is not None:
                    bits[from_gaps(x.as_buffer()), k >> 3] |= 0x80 >> (k & 7)
            at = lo >> 3
            for row, node, ids in zip(far[:, at : at + bits.shape[1]], nodes, near, strict=True):
                np.bitwise_or.reduce(bits[ids], axis=0, out=row)
                row &= ~bits[node]
                if 0 <= (own := node - first - lo) < size:
                    row[own >> 3] &= ~np.uint8(0x80 >> (own & 7))
        return pa.table([left["node"].combine_chunks(), pa.array(np.full(len(nodes), rb, "i4")), pa.array([x.tobytes() for x in far], pa.binary())], schema=schema)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = max(1, 500_000 // len(names))
            for lo in range(0, len(batch), few):
                part = batch[lo : lo + few]
                found = [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))) + rb * block for x, rb in zip(part["far"], part["rb"].to_pylist(), strict=True)]
                node = np.repeat(part["node"].to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(np.concatenate(found)))], ["node", "reach"])

    near = edges.mapInArrow(numbered, "node int, near array<int>").groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = _kept(near.mapInArrow(packed, "node int, near binary"))
    every, own = f"explode(sequence(0, {blocks - 1}))", F.expr(f"cast(node div {block} as int)")
    left = near.withColumn("lb", own).withColumn("rb", F.expr(every))
    right = near.select(F.col("node").alias("node"), F.col("near").alias("near")).withColumn("rb", own).withColumn("lb", F.expr(every))
    met = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, "node int, rb int, far binary")
    return met.mapInArrow(named, "node string, reach string")


# Kernels on one window's correlation matrix. NaN stands for pairs with too few common dates.


def correlation_matrix(x: np.ndarray, least: int, ranks: bool = False) -> np.ndarray:
    """Pairwise complete correlations of the columns of x (dates x tickers); Spearman's on average ranks if asked for."""
    if ranks:
        x = pd.DataFrame(x).rank().to_numpy()
    ok = ~np.isnan(x)
    z = np.where(ok, x, 0.0)
    n = ok.T.astype(float) @ ok
    with np.errstate(all="ignore"):
        sx, sxx = z.T @ ok, (z * z).T @ ok
        cov = z.T @ z / n - (sx / n) * (sx.T / n)
        var = sxx / n - (sx / n) ** 2
        rho = cov / np.sqrt(var * var.T)
    rho[(n < least) | ~np.isfinite(rho)] = np.nan
    return np.clip(rho, -1, 1)


def random_matrix_filter(rho: np.ndarray, n_dates: int, drop_market: bool = False) -> np.ndarray:
    """Keeps eigenvalues above (1 + sqrt(N / T))^2, without the largest if asked for; NaN cells stay NaN."""
    values, vectors = np.linalg.eigh(np.nan_to_num(rho))
    keep = values > (1 + np.sqrt(len(rho) / n_dates)) ** 2
    if drop_market and keep.any():
        keep[np.argmax(values)] = False
    out = (vectors[:, keep] * values[keep]) @ vectors[:, keep].T
    return np.where(np.isnan(rho), np.nan, out)


def _ordered_pairs(rho: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(rho), 1)
    ok = ~np.isnan(rho[i, j])
    i, j = i[ok], j[ok]
    order = np.lexsort((j, i, -rho[i, j]))
    return np.stack([i[order], j[order]], axis=1)


def spanning_tree(rho: np.ndarray) -> list[tuple[int, int]]:
    """Kruskal's tree (or forest) on descending correlation."""
    parent = list(range(len(rho)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    edges = []
    for i, j in _ordered_pairs(rho).tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            edges.append((i, j))
    return edges


def complete_linkage(rho: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by complete linkage on sqrt(2 (1 - rho)), missing correlations as 0."""
    d = np.sqrt(2 * (1 - np.nan_to_num(rho)))
    np.fill_diagonal(d, np.inf)
    labels = np.arange(len(rho))
    for _ in range(len(rho) - k):
        i, j = divmod(int(np.argmin(d)), len(d))
        i, j = min(i, j), max(i, j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return label


def spectral(adjacency: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels from the leading eigenvectors of the normalised adjacency, rows scaled to length 1."""
    degree = np.maximum(adjacency.sum(axis=1), 1e-12)
    s = adjacency / np.sqrt(degree[:, None] * degree[None])
    x = np.linalg.eigh(s)[1][:, -k:]
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k, seed)


def walks(neighbours: list[list[int]], length: int = 10, each: int = 10, p: float = 0.5, q: float = 2.0, seed: int = 0) -> Iterator[list[int]]:
    """Biased second-order random walks: 1/p back, 1 to common neighbours, 1/q away."""
    rng = np.random.default_rng(seed)
    sets = [set(x) for x in neighbours]
    for start in range(len(neighbours)):
        for _ in range(each):
            walk = [start]
            while len(walk) < length and neighbours[walk[-1]]:
                here = neighbours[walk[-1]]
                if len(walk) == 1:
                    walk.append(int(rng.choice(here)))
                    continue
                w = np.array([1 / p if x == walk[-2] else 1.0 if x in sets[walk[-2]] else 1 / q for x in here])
                walk.append(int(rng.choice(here, p=w / w.sum())))
            yield walk


def embedded(corpus: Iterable[list[int]], n: int, dims: int = 16, window: int = 5) -> np.ndarray:
    """Vectors of nodes from walk co-occurrence: shifted pointwise mutual information, factorised."""
    if n > WHOLE:
        return sparse_embedded(corpus, n, dims, window)
    c = np.zeros((n, n))
    for walk in corpus:
        for i, a in enumerate(walk):
            for b in walk[max(0, i - window) : i]:
                c[a, b] += 1
                c[b, a] += 1
    total = max(c.sum(), 1.0)
    with np.errstate(all="ignore"):
        pmi = np.log(c * total / (c.sum(axis=1)[:, None] * c.sum(axis=0)[None]))
    pmi = np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0)
    u, s, _ = np.linalg.svd(pmi)
    return u[:, :dims] * np.sqrt(s[:dims])


def _leading(times: Callable[[np.ndarray], np.ndarray], step: Callable[[np.ndarray], np.ndarray], n: int, k: int, rounds: int, size: Callable = np.asarray) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenpairs of ``times`` that ``size`` puts last, ascending: a block of vectors goes through ``step`` until they hold to 1e-12, or for so many rounds."""
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, k + 25)))[0]
    for _ in range(rounds):
        x = np.linalg.qr(step(x))[0]
        sx = times(x)
        values, turn = np.linalg.eigh(x.T @ sx)
        order = np.argsort(size(values), kind="stable")
        values, x, sx = values[order], x @ turn[:, order], sx @ turn[:, order]
        if np.abs(sx[:, -k:] - x[:, -k:] * values[-k:]).max() < 1e-12 * max(1.0, np.abs(values).max()):
            break
    return values[-k:], x[:, -k:]


def sparse_embedded(corpus: Iterable[list[int]], n: int, dims: int = 16, window: int = 5) -> np.ndarray:
    """As ``embedded``, with only the pairs that occur."""
    keys, counts, part = np.zeros(0, np.int64), np.zeros(0), []

    def counted(part: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        walked = np.full((len(part), max(map(len, part))), -1, np.int64)
        for row, walk in zip(walked, part, strict=True):
            row[: len(walk)] = walk
        found = [keys]
        weights = [counts]
        for gap in range(1, window + 1):
            a, b = walked[:, gap:].ravel(), walked[:, :-gap].ravel()
            a, b = a[a >= 0], b[a >= 0]
            found += [a * n + b, b * n + a]
        new, at = np.unique(np.concatenate(found), return_inverse=True)
        weights.append(np.ones(len(at) - len(counts)))
        return new, np.bincount(at, np.concatenate(weights), len(new))

    for walk in corpus:
        part.append(walk)
        if len(part) == 50_000:
            keys, counts = counted(part)
            part = []
    if part:
        keys, counts = counted(part)
    a, b = keys // n, keys % n
    total, each = max(counts.sum(), 1.0), np.bincount(a, counts, n)
    pmi = np.maximum(np.log(counts * total / (each[a] * each[b])), 0)
    starts = _starts(a) if len(a) else a
    cuts = [*starts[np.searchsorted(starts, np.arange(0, len(a), 100_000))].tolist()] if len(a) else []
    cuts = [*dict.fromkeys(cuts), len(a)]

    def times(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = _starts(a[lo:hi])
            y[a[lo:hi][at]] = np.add.reduceat(x[b[lo:hi]] * pmi[lo:hi, None], at, axis=0)
        return y

    values, x = _leading(times, times, n, dims, 100, np.abs)
    return x[:, ::-1] * np.sqrt(np.abs(values[::-1]))


def forest_spectral(neighbours: list[list[int]], k: int, seed: int = 0) -> np.ndarray:
    """As ``spectral``, for a forest: its leading eigenvectors by inverse iteration, eliminating from the leaves to the roots."""
    n = len(neighbours)
    parent, levels, seen = np.full(n, -1), [], np.zeros(n, bool)
    level = []
    for root in range(n):  # all trees are walked at once: roots first
        if not seen[root]:
            level.append(root)
            seen[root], stack = True, [root]
            while stack:
                for b in neighbours[stack.pop()]:
                    if not seen[b]:
                        seen[b] = True
                        stack.append(b)
    while level:
        levels.append(np.array(level))
        below = []
        for a in level:
            for b in neighbours[a]:
                if b != parent[a]:
                    parent[b] = a
                    below.append(b)
        level = below
    degree = np.maximum([len(x) for x in neighbours], 1e-12)
    child = np.flatnonzero(parent >= 0)
    s = np.zeros(n)
    s[child] = 1 / np.sqrt(degree[child] * degree[parent[child]])
    d = np.full(n, 1 + 1e-8)
    steps = [(v, parent[v][(at := _starts(parent[v]))], at) for v in levels[1:]]
    for v, up, at in reversed(steps):
        d[up] -= np.add.reduceat(s[v] ** 2 / d[v], at)

    def solve(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for v, up, at in reversed(steps):
            x[up] += np.add.reduceat((s[v] / d[v])[:, None] * x[v], at, axis=0)
        x[levels[0]] /= d[levels[0], None]
        for v, _, _ in steps:
            x[v] = (x[v] + s[v][:, None] * x[parent[v]]) / d[v, None]
        return x

    def times(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for v, up, at in steps:
            y[up] += np.add.reduceat(s[v][:, None] * x[v], at, axis=0)
            y[v] += s[v][:, None] * x[parent[v]]
        return y

    x = _leading(times, solve, n, k, 60)[1]
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k, seed)


#: Upper bounds of the bins of degree ratios but the last.
DEGREE_BOUNDS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.5, 0.75)


def degree_bucket(ratio: float) -> int | None:
    """One of 8 half-open bins of [0, 1); None from 1 on."""
    return bisect_right(DEGREE_BOUNDS, ratio) if 0 <= ratio < 1 else None


def node2vec(neighbours: list[list[int]], k: int, seed: int = 0) -> np.ndarray:
    return kmeans(embedded(walks(neighbours, seed=seed), len(neighbours)), k, seed)


def sub2vec(neighbours: list[list[int]], k: int, seed: int = 0, length: int = 5, each: int = 10) -> np.ndarray:
    """Each node's two-hop subgraph as a mean of walk vectors, of ids and of degree buckets, clustered."""
    n = len(neighbours)
    by_id = embedded(walks(neighbours, seed=seed), n)
    rng = np.random.default_rng(seed)
    out = []
    for a in range(n):
        near = sorted({a, *neighbours[a], *(c for b in neighbours[a] for c in neighbours[b])})
        inside = set(near)
        ids, degrees = [], np.zeros(9)
        for _ in range(each):
            at = int(rng.choice(near))
            for _ in range(length):
                ids.append(at)
                bucket = degree_bucket(len(neighbours[at]) / max(1, len(near)))
                degrees[8 if bucket is None else bucket] += 1
                step = [x for x in neighbours[at] if x in inside]
                if not step:
                    break
                at = int(rng.choice(step))
        out.append(np.r_[by_id[ids].mean(axis=0), degrees / degrees.sum()])
    return kmeans(np.array(out), k, seed)


def louvain(adjacency: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Labels by local moves that gain within-cluster weight over the expected one, repeated on merged clusters."""
    labels = np.arange(len(adjacency))
    w = adjacency.astype(float).copy()
    while True:
        own, degree, total = np.arange(len(w)), w.sum(axis=1), max(w.sum(), 1e-12)
        moved = False
        for _ in range(rounds):
            changed = False
            for i in range(len(w)):
                gain = np.bincount(own, w[i], len(w)) - degree[i] * np.bincount(own, degree, len(w)) / total
                gain[own[i]] -= w[i, i] - degree[i] ** 2 / total
                best = int(np.argmax(gain))
                if gain[best] > gain[own[i]] + 1e-12:
                    own[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            return np.unique(labels, return_inverse=True)[1]
        kinds, own = np.unique(own, return_inverse=True)
        labels = own[labels]
        one = np.eye(len(kinds))[own]
        w = one.T @ w @ one


def block_correlations(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Correlations of the rows of x with those of y as in ``correlation_matrix``, to 12 decimals, so that ties don't hang on the order of sums."""
    ox, oy = ~np.isnan(x), ~np.isnan(y)
    with np.errstate(all="ignore"):
        if ox.all() and oy.all():
            zx, zy = (v - v.mean(axis=1, keepdims=True) for v in (x, y))
            zx, zy = (z / np.where((s := np.sqrt((z * z).sum(axis=1, keepdims=True))) > 1e-10, s, np.nan) for z in (zx, zy))
            rho = zx @ zy.T
            if x.shape[1] < least:
                rho[:] = np.nan
        else:
            zx, zy, ox, oy = np.where(ox, x, 0.0), np.where(oy, y, 0.0), ox.astype(float), oy.astype(float)
            n = ox @ oy.T
            mx, my = zx @ oy.T / n, ox @ zy.T / n
            rho = (zx @ zy.T / n - mx * my) / np.sqrt(((zx * zx) @ oy.T / n - mx * mx) * (ox @ (zy * zy).T / n - my * my))
            rho[(n < least) | ~np.isfinite(rho)] = np.nan
    return np.round(np.clip(rho, -1, 1, out=rho), 12, out=rho)


def window_rows(panel: DataFrame, windows: list[tuple[int, int, int]], x: str = "ret") -> DataFrame:
    """(window_id, ticker, x): a window's values by date, null where there is none."""
    got = window_cells(panel, windows, x).groupBy("window_id", "ticker").agg(F.sort_array(F.collect_list(F.struct("date_idx", F.col("x").cast("double").alias("x")))).alias("x"))
    return got.withColumn("x", F.col("x.x"))


def block_pairs(rows: DataFrame, by: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of blocks of ``by``, each pair once."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))
    left = placed.withColumnRenamed("block", "lb").withColumn("rb", F.expr(f"explode(sequence(lb, {blocks - 1}))"))
    again = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # or both sides' columns would be the same
    return left, again.withColumnRenamed("block", "rb").withColumn("lb", F.expr("explode(sequence(0, rb))"))


def _joined(parent: list[int], edges) -> list[int]:
    """Positions of the edges that join two trees, in the order given."""

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    kept = []
    for at, (i, j) in enumerate(edges):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(at)
    for i in range(len(parent)):
        parent[i] = find(i)
    return kept


def block_forest(rho: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rho) of the maximum spanning forest between ascending names left and right: each tree takes its best edge, until none is left. Ties fall as in ``spanning_tree``."""
    best = np.where(np.isnan(rho), -np.inf, rho)
    names = np.union1d(left, right)
    li, ri = np.searchsorted(names, left), np.searchsorted(names, right)
    best[li[:, None] == ri[None]] = -np.inf
    parent, got = list(range(len(names))), []
    while True:
        rows, columns = best.argmax(axis=1), best.argmax(axis=0)
        i, j = np.r_[np.arange(len(left)), columns], np.r_[rows, np.arange(len(right))]
        v = best[i, j]
        i, j, v = i[v > -np.inf], j[v > -np.inf], v[v > -np.inf]
        if not len(v):
            break
        lo, hi = np.minimum(li[i], ri[j]), np.maximum(li[i], ri[j])
        order = np.lexsort((hi, lo, -v))
        label = np.array(parent)
        first = np.zeros(len(order), bool)
        first[np.unique(label[np.stack([lo[order], hi[order]], axis=1)], return_index=True)[1] // 2] = True  # a tree's best edge at either end
        order = order[first]
        kept = order[_joined(parent, zip(lo[order].tolist(), hi[order].tolist(), strict=True))]
        got.append(np.stack([i[kept], j[kept]]))
        label = np.array(parent)
        best[label[li][:, None] == label[ri][None]] = -np.inf
    i, j = np.concatenate(got, axis=1) if got else np.zeros((2, 0), int)
    return i, j, rho[i, j]


def spanning_edges(panel: DataFrame, windows: list[tuple[int, int, int]], least: int, n: int, x: str = "ret", block: int | None = None, tile: int = 2000) -> DataFrame:
    """(window_id, a, b, rho): each window's spanning tree. The tree of all pairs lies in the union of the forests of pairs of blocks, and these in the union of their tiles'; unions of 16 are thinned again until one is left, so that a task holds two blocks' values and a tile's correlations, or 16 forests."""
    blocks = -(-n // (block or block_size(n, 2000, 16_000)))
    left, right = block_pairs(window_rows(panel, windows, x), "ticker", blocks)
    schema = "window_id int, part int, a string, b string, rho double"

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"window_id": [], "part": [], "a": [], "b": [], "rho": []}).astype({"window_id": "i4", "part": "i4", "a": "str", "b": "str", "rho": "f8"})
        left, right = left.sort_values("ticker"), right.sort_values("ticker")
        part = int(left["lb"].iloc[0]) * blocks + int(left["rb"].iloc[0])
        p, q = left["ticker"].to_numpy(str), right["ticker"].to_numpy(str)
        x, y = np.stack(left["x"]), np.stack(right["x"])
        same, out = part % (blocks + 1) == 0, []
        for lo in range(0, len(p), tile):
            for to in range(lo if same else 0, len(q), tile):
                i, j, rho = block_forest(block_correlations(x[lo : lo + tile], y[to : to + tile], least), p[lo : lo + tile], q[to : to + tile])
                i, j = i + lo, j + to
                a, b = np.where(p[i] < q[j], (p[i], q[j]), (q[j], p[i]))
                out.append(pd.DataFrame({"window_id": int(left["window_id"].iloc[0]), "part": part, "a": a, "b": b, "rho": rho}))
        return thin(pd.concat(out)) if len(out) > 1 else out[0]

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rho", "a", "b"], ascending=[False, True, True])
        names, at = np.unique(np.r_[pdf["a"].to_numpy(str), pdf["b"].to_numpy(str)], return_inverse=True)
        ends = at.reshape(2, -1).T.tolist()
        return pdf.iloc[_joined(list(range(len(names))), ends)]

    keys = ("window_id", "lb", "rb")
    edges = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)
    parts = blocks * blocks
    while parts > 1:
        parts = -(-parts // 16)
        edges = edges.withColumn("part", F.expr("cast(part div 16 as int)")).groupBy("window_id", "part").applyInPandas(thin, schema)
    return edges.drop("part")


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair that is the same from both sides, below 2^31: where many pairs are equally near, most find a partner."""
    ha, hb = (np.array([zlib.crc32(v.encode()) for v in x], np.uint64) for x in (a, b))
    m = (ha[:, None] ^ hb[None]) * np.uint64(0x9E3779B97F4A7C15)
    return (m >> np.uint64(33)).astype(np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def nearness(left: pd.DataFrame, right: pd.DataFrame, least: int, tile: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of both sides and the lowest correlation of any member of one with any of the other, missing ones as 0; rows are sorted by cluster."""
    p, q = left["cluster"].to_numpy(str), right["cluster"].to_numpy(str)
    x, y = np.stack(left["x"]), np.stack(right["x"])
    a, at = np.unique(p, return_inverse=True)
    b, to = np.unique(q, return_inverse=True)
    low = np.full((len(a), len(b)), np.inf)
    for i in range(0, len(p), tile):
        for j in range(0, len(q), tile):
            rho = np.nan_to_num(block_correlations(x[i : i + tile], y[j : j + tile], least))
            m = np.minimum.reduceat(np.minimum.reduceat(rho, _starts(q[j : j + tile]), axis=1), _starts(p[i : i + tile]), axis=0)
            part = np.s_[at[i] : at[min(i + tile, len(p)) - 1] + 1, to[j] : to[min(j + tile, len(q)) - 1] + 1]
            low[part] = np.minimum(low[part], m)
    low[a[:, None] == b[None]] = -np.inf
    return a, b, low


def linkage(low: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges (distance, kept, gone) of complete linkage on lowest correlations."""
    s = low.copy()
    np.fill_diagonal(s, -np.inf)
    best, out = s.argmax(axis=1), []
    value = s[np.arange(len(s)), best]
    for _ in range(len(s) - 1):
        i = int(value.argmax())
        i, j = sorted((i, int(best[i])))
        out.append((1 - s[i, j], i, j))
        s[i] = np.minimum(s[i], s[j])
        s[i, i] = -np.inf
        s[:, i] = s[i]
        s[j], s[:, j], value[j] = -np.inf, -np.inf, -np.inf
        stale = np.flatnonzero((best == i) | (best == j) | (np.arange(len(s)) == i))
        stale = stale[(value[stale] > -np.inf) | (stale == i)]
        best[stale] = s[stale].argmax(axis=1)
        value[stale] = s[stale, best[stale]]
    return out


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: a round doesn't repeat the rounds before it."""
    path = f"{results_dir(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def complete_by_blocks(rows: DataFrame, n: int, k: int, least: int, block: int = 2000, whole: int = WHOLE) -> DataFrame:
    """(window_id, ticker, label): exact complete linkage of more tickers than a matrix holds, from (window_id, ticker, x).

    Clusters that are each other's nearest merge in rounds: with complete linkage such merges are part of the tree in any order. Distances of clusters
    come from the members' values anew, by pairs of blocks. From ``whole`` clusters on, one matrix gives the other merges. The n - k lowest merges of all make the labels.
    """
    blocks = -(-n // block)
    keys = ("window_id", "lb", "rb")

    def sides(now: DataFrame):
        left, right = block_pairs(now, "cluster", blocks)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"window_id": [], "cluster": [], "other": [], "low": [], "tie": []}).astype({"window_id": "i4", "cluster": "str", "other": "str", "low": "f8", "tie": "i8"})
        left, right = left.sort_values("cluster"), right.sort_values("cluster")
        a, b, low = nearness(left, right, least)
        tie, out = _tie(a, b), []
        for low, tie, a, b in ((low, tie, a, b), (low.T, tie.T, b, a)):  # noqa: B020
            top = low.max(axis=1)
            at = np.where(low == top[:, None], tie, -1).argmax(axis=1)
            i = np.arange(len(a))
            out.append(pd.DataFrame({"cluster": a, "other": b[at], "low": top, "tie": tie[i, at]})[top > -np.inf])
        return pd.concat(out).assign(window_id=int(left["window_id"].iloc[0]))[["window_id", "cluster", "other", "low", "tie"]]

    def table(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"window_id": [], "cluster": [], "others": [], "low": []}).astype({"window_id": "i4", "cluster": "str", "others": "object", "low": "object"})
        left, right = left.sort_values("cluster"), right.sort_values("cluster")
        a, b, low = nearness(left, right, least)
        return pd.DataFrame({"window_id": int(left["window_id"].iloc[0]), "cluster": a, "others": [b.tolist()] * len(a), "low": list(low)})

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[pdf["cluster"].to_numpy(str), np.concatenate(list(pdf["others"])).astype(str)])
        low = np.full((len(names), len(names)), -np.inf)
        for c, others, v in zip(np.searchsorted(names, pdf["cluster"].to_numpy(str)), pdf["others"], pdf["low"], strict=True):
            at = np.searchsorted(names, np.asarray(others, str))
            low[c, at] = np.maximum(low[c, at], v)
            low[at, c] = np.maximum(low[at, c], v)
        d, i, j = (np.array(x) for x in zip(*linkage(low), strict=True))
        return pd.DataFrame({"window_id": int(pdf["window_id"].iloc[0]), "round": np.arange(1_000_000, 1_000_000 + len(d)), "d": d, "a": names[i], "b": names[j]})

    def cut(tickers: pd.DataFrame, merges: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(tickers["ticker"].to_numpy(str))
        merges = merges.sort_values(["d", "round"], kind="stable")
        parent = list(range(len(names)))
        ends = [np.searchsorted(names, merges[c].to_numpy(str)).tolist() for c in "ab"]
        _joined(parent, list(zip(*ends, strict=True))[: len(names) - k])
        return pd.DataFrame({"window_id": int(tickers["window_id"].iloc[0]), "ticker": names, "label": np.unique(parent, return_inverse=True)[1]})

    # equal rows with enough dates are at distance 0: one of them stands for all
    enough = F.expr(f"size(filter(x, v -> v is not null)) >= {least} and array_max(x) > array_min(x)")
    alike = Window.partitionBy("window_id", F.when(enough, F.col("x")), F.when(~enough, F.col("ticker")))
    placed = _kept(rows.withColumn("cluster", F.min("ticker").over(alike)))
    merges = placed.where("ticker <> cluster").select("window_id", F.lit(0).alias("round"), F.lit(0.0).alias("d"), F.col("cluster").alias("a"), F.col("ticker").alias("b"))
    now, step = placed.where("ticker = cluster"), 0
    while max((r[0] for r in now.groupBy("window_id").agg(F.countDistinct("cluster").alias("n")).select("n").collect()), default=0) > whole:
        step += 1
        near = sides(now).applyInPandas(nearest, "window_id int, cluster string, other string, low double, tie long")
        near = near.groupBy("window_id", "cluster").agg(F.max(F.struct("low", "tie", "other")).alias("m")).select("window_id", "cluster", "m.*")
        back = near.select("window_id", F.col("cluster").alias("other"), F.col("other").alias("cluster"))
        pairs = _kept(near.join(back, ["window_id", "cluster", "other"]).where("cluster < other").select("window_id", F.lit(step).alias("round"), (1 - F.col("low")).alias("d"), F.col("cluster").alias("a"), F.col("other").alias("b")))
        merges = merges.unionByName(pairs)
        now = _kept(now.join(pairs.select("window_id", F.col("b").alias("cluster"), "a"), ["window_id", "cluster"], "left").withColumn("cluster", F.coalesce("a", "cluster")).drop("a"))
    left_over = sides(now).applyInPandas(table, "window_id int, cluster string, others array<string>, low array<double>").groupBy("window_id").applyInPandas(rest, "window_id int, round int, d double, a string, b string")
    tickers, merges = placed.select("window_id", "ticker"), merges.unionByName(left_over)
    return tickers.groupBy("window_id").cogroup(merges.groupBy("window_id")).applyInPandas(cut, "window_id int, ticker string, label int")


def window_cells(panel: DataFrame, windows: list[tuple[int, int, int]], x: str = "ret") -> DataFrame:
    w = panel.sparkSession.createDataFrame(windows, "window_id int, lo int, hi int")
    return panel.join(F.broadcast(w), F.col("date_idx").between(F.col("lo"), F.col("hi"))).select("window_id", "ticker", "date_idx", F.col(x).alias("x"))


def window_graph(panel: DataFrame, windows: list[tuple[int, int, int]], kind: str, least: int = 20) -> DataFrame:
    """(window_id, a, b, rho): each window's spanning tree ('mst') or planar filtered graph ('pmfg')."""
    if kind == "mst" and (n := panel.select("ticker").distinct().count()) > WHOLE:
        return spanning_edges(panel, windows, least, n)
    if kind == "pmfg" and panel.select("ticker").distinct().count() > WHOLE:
        return by_strips(panel, windows, "edges", 0, least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .planar import filtered_graph

        wide = pdf.pivot(index="date_idx", columns="ticker", values="x")
        rho = correlation_matrix(wide.to_numpy(float), least)
        edges = np.array({"mst": spanning_tree, "pmfg": filtered_graph}[kind](rho), int).reshape(-1, 2)
        names = wide.columns.to_numpy()
        return pd.DataFrame({"window_id": int(pdf["window_id"].iloc[0]), "a": names[edges[:, 0]], "b": names[edges[:, 1]], "rho": rho[edges[:, 0], edges[:, 1]]})

    return window_cells(panel, windows).groupBy("window_id").applyInPandas(run, "window_id int, a string, b string, rho double")


#: Clusterings that see a window's spanning tree alone.
TREE_METHODS = {"spectral": forest_spectral, "node2vec": node2vec, "sub2vec": sub2vec}


def tree_clustered(tickers: DataFrame, edges: DataFrame, method: str, k: int) -> DataFrame:
    """(window_id, ticker, label): a task holds one window's tree."""

    def run(tickers: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(tickers["ticker"].to_numpy(str))
        seed = int(tickers["window_id"].iloc[0])
        edges = edges.sort_values(["rho", "a", "b"], ascending=[False, True, True])
        near = [[] for _ in names]
        for i, j in zip(*(np.searchsorted(names, edges[c].to_numpy(str)).tolist() for c in "ab"), strict=True):
            near[i].append(j)
            near[j].append(i)
        return pd.DataFrame({"window_id": seed, "ticker": names, "label": TREE_METHODS[method](near, k, seed)})

    return tickers.groupBy("window_id").cogroup(edges.groupBy("window_id")).applyInPandas(run, "window_id int, ticker string, label int")


def by_strips(panel: DataFrame, windows: list[tuple[int, int, int]], method: str, k: int, least: int, x: str = "ret") -> DataFrame:
    """Filtered linkage, Louvain and planar graphs of many tickers: a task holds one window's values, never its matrix. Method 'edges' gives (window_id, a, b, rho), others (window_id, ticker, label)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from . import strips as S
        from .planar import filtered_edges

        pdf = pdf.sort_values("ticker")
        names, seed = pdf["ticker"].to_numpy(str), int(pdf["window_id"].iloc[0])
        rho = S.Strips(np.stack(pdf["x"]).astype(float), least)
        if method == "filtered":
            label = S.linked(rho, S.filtered_factors(rho), k)
        elif method == "louvain":
            label = S.louvain_by_strips(rho)
        else:
            edges = list(filtered_edges(len(names), S.ordered_pairs(rho)))
            if method == "edges":
                i, j, r = zip(*edges, strict=True) if edges else ((), (), ())
                return pd.DataFrame({"window_id": seed, "a": names[list(i)], "b": names[list(j)], "rho": np.array(r, float)})
            near = [[] for _ in names]
            for i, j, _ in edges:
                near[i].append(j)
                near[j].append(i)
            label = {"pmfg_spectral": S.sparse_spectral, "pmfg_node2vec": node2vec}[method](near, k, seed)
        return pd.DataFrame({"window_id": seed, "ticker": names, "label": label})

    schema = "window_id int, a string, b string, rho double" if method == "edges" else "window_id int, ticker string, label int"
    return window_rows(panel, windows, x).groupBy("window_id").applyInPandas(run, schema)


def clustered(panel: DataFrame, windows: list[tuple[int, int, int]], method: str, k: int, least: int = 20, x: str = "ret") -> DataFrame:
    """(window_id, ticker, label) for each window (id, first and last date index): one matrix per task."""
    n = panel.select("ticker").distinct().count()
    if n > WHOLE and method == "complete":
        return complete_by_blocks(window_rows(panel, windows, x), n, k, least)
    if n > WHOLE and method in TREE_METHODS:
        return tree_clustered(window_cells(panel, windows, x).select("window_id", "ticker").distinct(), spanning_edges(panel, windows, least, n, x), method, k)
    if n > WHOLE:
        return by_strips(panel, windows, method, k, least, x)
    cells = window_cells(panel, windows, x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date_idx", columns="ticker", values="x")
        rho = correlation_matrix(wide.to_numpy(float), least)
        n = len(rho)
        seed = int(pdf["window_id"].iloc[0])
        from .planar import filtered_graph

        edges = filtered_graph(rho) if method.startswith("pmfg") else spanning_tree(rho)
        near = [[] for _ in range(n)]
        for i, j in edges:
            near[i].append(j)
            near[j].append(i)
        adjacency = np.zeros((n, n))
        for i, j in edges:
            adjacency[i, j] = adjacency[j, i] = 1
        label = {
            "complete": lambda: complete_linkage(rho, k),
            "filtered": lambda: complete_linkage(random_matrix_filter(rho, len(wide)), k),
            "spectral": lambda: spectral(adjacency, k, seed),
            "node2vec": lambda: node2vec(near, k, seed),
            "sub2vec": lambda: sub2vec(near, k, seed),
            "louvain": lambda: louvain(np.maximum(np.nan_to_num(rho) - np.eye(n), 0)),
        }[method.removeprefix("pmfg_")]()
        return pd.DataFrame({"window_id": seed, "ticker": wide.columns, "label": label})

    return cells.groupBy("window_id").applyInPandas(run, "window_id int, ticker string, label int")


def dynamic_industry(panel: DataFrame, labels: DataFrame, tests: list[tuple[int, int, int]]) -> DataFrame:
    """Labels held over each window's test dates, -1 for tickers without one."""
    t = panel.sparkSession.createDataFrame(tests, "window_id int, lo int, hi int")
    cells = panel.join(F.broadcast(t), F.col("date_idx").between(F.col("lo"), F.col("hi"))).select("window_id", "ticker", "trade_date")
    return cells.join(labels, ["window_id", "ticker"], "left").select("ticker", "trade_date", F.coalesce("label", F.lit(-1)).alias("label"))
