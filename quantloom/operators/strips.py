"""A window's correlations by strips of rows: what follows from them without the matrix of all pairs.

Memory of a task grows with tickers x dates (and a strip of STRIP cells), work with the square of the tickers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .graph import WHOLE, _joined, _starts, kmeans, linkage, louvain

#: Cells of a strip.
STRIP = 3_000_000


class Strips:
    """Correlations of some rows of x (tickers x dates, NaN where there is no value) with all, as ``correlation_matrix`` has them.

    Rows with all values are scaled once, so that a strip is one product; others meet the rest over their common dates.
    """

    def __init__(self, x: np.ndarray, least: int):
        self.x, self.least, self.n = x, least, len(x)
        self.size = max(1, STRIP // max(1, self.n))
        there = ~np.isnan(x)
        self.dates = there.sum(axis=1)
        self.odd = np.flatnonzero(self.dates < x.shape[1])
        self.is_odd = self.dates < x.shape[1]
        z = x - x.mean(axis=1, keepdims=True)
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        with np.errstate(all="ignore"):
            z /= np.where(length > 1e-10, length, np.nan)
        if x.shape[1] < least:
            z[:] = np.nan
        self.constant = np.isnan(z[:, 0]) & ~self.is_odd
        z[self.is_odd] = 0
        self.z = z
        self.there = there.astype(float)
        self.zeros = np.where(there, x, 0.0)
        self.squares = self.zeros * self.zeros

    def between(self, at: np.ndarray, to: np.ndarray | slice = slice(None)) -> np.ndarray:
        """As ``block_correlations`` of rows of which some lack values, from what is known of all rows."""
        x, y, ox, oy = self.zeros[at], self.zeros[to], self.there[at], self.there[to]
        with np.errstate(all="ignore"):
            n = ox @ oy.T
            mx, my = x @ oy.T / n, ox @ y.T / n
            rho = (x @ y.T / n - mx * my) / np.sqrt((self.squares[at] @ oy.T / n - mx * mx) * (ox @ self.squares[to].T / n - my * my))
        rho[(n < self.least) | ~np.isfinite(rho)] = np.nan
        return np.round(np.clip(rho, -1, 1, out=rho), 12, out=rho)

    def __call__(self, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """``own``: the correlations of those of the rows that lack values, if they are known."""
        rho = self.z[at] @ self.z.T
        if len(self.odd):
            rho[:, self.odd] = self.between(at, self.odd)
            if (is_odd := self.is_odd[at]).any():
                rho[is_odd] = self.between(at[is_odd]) if own is None else own
        return np.minimum(rho, 1, out=rho)

    def all(self, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and their correlations, strip by strip. Rows that lack values are slow one by one, so those of some strips are met together."""
        of = np.arange(self.n) if of is None else of
        some, before = max(1, self.size // 4), np.r_[0, np.cumsum(self.is_odd[of])]
        lo = 0
        while lo < len(of):
            hi = min(len(of), int(np.searchsorted(before, before[lo] + some, side="right")) - 1)
            own = self.between(of[lo:hi][self.is_odd[of[lo:hi]]])
            for at in range(lo, hi, self.size):
                part = of[at : min(hi, at + self.size)]
                yield part, self(part, own[before[at] - before[lo] : before[at + len(part)] - before[lo]])
            lo = hi

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix, missing cells as 0, times the columns of v."""
        z = np.nan_to_num(self.z)
        y = z @ (z.T @ v)
        rest = ~self.is_odd
        for at, rho in self.all(self.odd):
            rho = np.nan_to_num(rho)
            y[at] = rho @ v
            y[rest] += rho[:, rest].T @ v[at]
        return y

    def loose(self) -> np.ndarray:
        """Rows that may lack a correlation with some other one: too few common dates, or constant on them."""
        gone = self.x.shape[1] - int(self.dates.min(initial=self.x.shape[1]))
        few = self.dates - gone < self.least
        same = np.zeros(self.n, int)
        for i in range(self.n):
            if len(v := self.x[i][~np.isnan(self.x[i])]):
                same[i] = np.unique(v, return_counts=True)[1].max()
        return np.flatnonzero(few | self.constant | (self.dates - same <= gone))


def filtered_factors(rho: Strips, rounds: int = 100) -> np.ndarray:
    """U with U U' = ``random_matrix_filter`` of the matrix: its eigenpairs above the bound, by iterating a block of vectors.

    The eigenvalues add up to the tickers at most, so fewer than the dates are above the bound.
    """
    n, t = rho.x.shape
    bound = (1 + np.sqrt(n / t)) ** 2
    v = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(n, t + 25))))[0]
    for _ in range(rounds):
        rv = rho.times(v)
        values, turn = np.linalg.eigh((v.T @ rv + rv.T @ v) / 2)
        v, rv = v @ turn, rv @ turn
        near = values > 0.999 * bound
        if np.abs(rv[:, near] - v[:, near] * values[near]).max(initial=0) < 1e-11 * max(1.0, np.abs(values).max()) and _ > 2:
            break
        v = np.linalg.qr(rv)[0]
    keep = values > bound
    return v[:, keep] * np.sqrt(values[keep])


def linked(rho: Strips, u: np.ndarray, k: int, whole: int = WHOLE) -> np.ndarray:
    """Labels of k clusters by complete linkage on U U', missing correlations as 0: chains of nearest neighbours, whose merges are those of the tree.

    A cluster's similarities come from its members when a chain reaches it; nothing is kept of pairs. From ``whole`` clusters on, their matrix gives the other merges.
    """
    n = len(u)
    if not u.shape[1]:  # all are equally far: the first ones merge, in order
        return np.maximum(np.arange(n) - max(0, n - k), 0)
    loose = rho.loose()
    is_loose = np.zeros(n, bool)
    is_loose[loose] = True
    members: list[np.ndarray] = [np.array([i]) for i in range(n)]
    order = names = np.arange(n)  # rows laid out by cluster; names: the cluster of each run
    v, starts, place = np.ascontiguousarray(u.T), np.arange(n), np.arange(n)  # place: the run that stands for a cluster
    gone: list[int] = []
    into = np.arange(n)  # run -> run that stands for its cluster

    def similar(a: int) -> np.ndarray:
        """By run: the lowest similarity of any member, -inf where the run stands for no cluster."""
        low = np.full(n, np.inf)
        for lo in range(0, len(members[a]), rho.size):
            at = members[a][lo : lo + rho.size]
            s = u[at] @ v
            if len(loose):
                s[:, position[loose]] = np.where(np.isnan(rho.between(at, loose)), 0.0, s[:, position[loose]])
                for i in np.flatnonzero(is_loose[at]):
                    s[i, position] = np.where(np.isnan(rho.between(at[i : i + 1])[0]), 0.0, s[i, position])
            low = np.minimum(low, s.min(axis=0) if len(s) > 1 else s[0])
        got = low if len(starts) == n else np.minimum.reduceat(low, starts)
        if gone:
            old = np.array(gone)
            np.minimum.at(got, into[old], got[old].copy())
            got[old] = -np.inf
        got[place[a]] = -np.inf
        return got

    position = np.arange(n)
    alive = np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    first = 0
    while n - len(merges) > max(1, whole):
        if not chain:
            while not alive[first]:
                first += 1
            chain = [first]
        s = similar(chain[-1])
        top = s.max()
        if len(chain) > 1 and s[place[chain[-2]]] >= top - 1e-12 * max(1.0, abs(top)):
            b, a = sorted((chain.pop(), chain.pop()), reverse=True)
            merges.append((-float(top), a, b))
            members[a] = np.concatenate([members[a], members[b]])
            members[b] = members[b][:0]
            alive[b] = False
            to, old = place[a], place[b]
            into[into == old] = to
            gone.append(int(old))
            if len(gone) > max(50, len(starts) // 20):  # lay the rows out anew
                names = np.flatnonzero(alive)
                order = np.concatenate([members[c] for c in names])
                starts = np.r_[0, np.cumsum([len(members[c]) for c in names])[:-1]]
                position = np.empty(n, int)
                position[order] = np.arange(n)
                v = np.ascontiguousarray(u[order].T)
                place[names] = np.arange(len(names))
                into, gone = np.arange(len(names)), []
        else:
            chain.append(int(names[s.argmax()]))
    if n - len(merges) > 1:
        left = np.flatnonzero(alive)
        low = np.array([similar(a)[place[left]] for a in left.tolist()])
        merges += [(d - 1, int(left[a]), int(left[b])) for d, a, b in linkage(np.minimum(low, low.T))]
    parent = list(range(n))
    merges.sort(key=lambda m: m[0])
    _joined(parent, [(a, b) for _, a, b in merges[: max(0, n - k)]])
    return np.unique(parent, return_inverse=True)[1]


def louvain_by_strips(rho: Strips, rounds: int = 20) -> np.ndarray:
    """``louvain`` on the positive correlations: the moves of single tickers strip by strip, those of clusters on their matrix."""

    def weights() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, w in rho.all():
            w = np.fmax(w, 0, out=w)  # missing ones as 0
            w[np.arange(len(at)), at] = 0
            yield at, w

    n = rho.n
    own, degree = np.arange(n), np.concatenate([w.sum(axis=1) for _, w in weights()])
    total, moved = max(degree.sum(), 1e-12), False
    for _ in range(rounds):
        changed = False
        for at, strip in weights():
            size = np.bincount(own, minlength=n)
            free = np.flatnonzero(size == 0)[: len(at) + 1]  # a strip's rows can take no more empty clusters, and the first is the one to take
            size[free] = 1
            labels = np.flatnonzero(size)
            into = np.searchsorted(labels, own)
            mass = np.bincount(into, degree, len(labels))
            for i, w in zip(at.tolist(), strip, strict=True):
                gain = np.bincount(into, w, len(labels)) - degree[i] * mass / total
                gain[into[i]] += degree[i] ** 2 / total
                best = int(np.argmax(gain))
                if gain[best] > gain[into[i]] + 1e-12:
                    into[i], changed, moved = best, True, True
                    mass = np.bincount(into, degree, len(labels))
            own = labels[into]
        if not changed:
            break
    if not moved:
        return own
    kinds, own = np.unique(own, return_inverse=True)
    between = np.zeros((len(kinds), len(kinds)))
    for at, strip in weights():
        np.add.at(between, own[at], np.array([np.bincount(own, w, len(kinds)) for w in strip]))
    return np.unique(louvain(between, rounds)[own], return_inverse=True)[1]


def ordered_pairs(rho: Strips, most: int = 1_000_000, bins: int = 1 << 16) -> Iterator[tuple[int, int, float]]:
    """(i, j, rho), i < j, by descending correlation, ties by i and j: only a band of about ``most`` pairs (and what ties with them) is held."""

    def cells(at: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(r) | (at[:, None] >= np.arange(rho.n)[None]), -1, np.minimum((np.nan_to_num(r) + 1) * (bins / 2), bins - 1)).astype("i4")

    counts = np.zeros(bins, np.int64)
    for at, r in rho.all():
        c = cells(at, r)
        counts += np.bincount(c[c >= 0], minlength=bins)
    high = bins
    while high > 0 and counts[:high].any():
        down = np.cumsum(counts[:high][::-1])
        low = max(0, high - max(1, int(np.searchsorted(down, most, side="right"))))
        parts = []
        for at, r in rho.all():
            c = cells(at, r)
            i, j = np.nonzero((c >= low) & (c < high))
            parts.append((at[i].astype("i4"), j.astype("i4"), r[i, j]))
        i, j, r = (np.concatenate(p) for p in zip(*parts, strict=True))
        for lo in range(0, len(order := np.lexsort((j, i, -r))), 10_000):
            o = order[lo : lo + 10_000]
            yield from zip(i[o].tolist(), j[o].tolist(), r[o].tolist(), strict=True)
        high = low


def sparse_spectral(neighbours: list[list[int]], k: int, seed: int = 0, degree: int = 40, rounds: int = 200) -> np.ndarray:
    """As ``spectral``, from lists of neighbours: its leading eigenvectors by Chebyshev polynomials of the scaled adjacency."""
    n = len(neighbours)
    size = np.array([len(x) for x in neighbours])
    a, b = np.repeat(np.arange(n), size), np.array([j for x in neighbours for j in x], int)
    d = np.maximum(size, 1e-12)
    w = 1 / np.sqrt(d[a] * d[b])
    at = _starts(a) if len(a) else a

    def times(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        if len(a):
            y[a[at]] = np.add.reduceat(x[b] * w[:, None], at, axis=0)
        return y

    x, low = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(n, k + 25))))[0], 0.0
    for _ in range(rounds):  # what is between -1 and low stays small, what is above grows
        half, mid = (low + 1) / 2, (low - 1) / 2
        before, now = x, (times(x) - mid * x) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (times(now) - mid * now) / half - before
        x = np.linalg.qr(now)[0]
        sx = times(x)
        values, turn = np.linalg.eigh(x.T @ sx)
        x, sx, low = x @ turn, sx @ turn, float(min(values[0], 0.999))
        if np.abs(sx[:, -k:] - x[:, -k:] * values[-k:]).max() < 1e-12:
            break
    x = x[:, -k:]
    return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), k, seed)
