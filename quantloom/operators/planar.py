"""Planar maximally filtered graphs: a left-right planarity test, after the published criterion of de Fraysseix and Rosenstiehl in Brandes' form."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np

from .graph import _ordered_pairs

Edge = tuple[int, int]


class _Pair:
    """Two intervals of back edges that have to lie on different sides; an interval is (low, high) or (None, None)."""

    __slots__ = ("left", "right")

    def __init__(self):
        self.left: list = [None, None]
        self.right: list = [None, None]

    def swap(self) -> None:
        self.left, self.right = self.right, self.left


class LeftRight:
    """Decides whether a simple undirected graph is planar."""

    def __init__(self, neighbours: list[list[int]]):
        self.adj = neighbours
        self.height: list[int | None] = [None] * len(neighbours)
        self.parent: list[Edge | None] = [None] * len(neighbours)
        self.out: list[list[Edge]] = [[] for _ in neighbours]
        self.low: dict[Edge, int] = {}
        self.low2: dict[Edge, int] = {}
        self.depth: dict[Edge, int] = {}
        self.ref: dict[Edge, Edge | None] = {}
        self.low_edge: dict[Edge, Edge] = {}
        self.bottom: dict[Edge, _Pair | None] = {}
        self.stack: list[_Pair] = []

    def planar(self) -> bool:
        n, m = len(self.adj), sum(map(len, self.adj)) // 2
        if n > 2 and m > 3 * n - 6:
            return False
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * n + 1000))
        roots = []
        for v in range(n):
            if self.height[v] is None:
                self.height[v] = 0
                roots.append(v)
                self._orient(v)
        for edges in self.out:
            edges.sort(key=self.depth.__getitem__)
        return all(self._test(v) for v in roots)

    def _orient(self, v: int) -> None:
        e = self.parent[v]
        for w in self.adj[v]:
            f = (v, w)
            if f in self.low or (w, v) in self.low:
                continue
            self.out[v].append(f)
            self.low[f] = self.low2[f] = self.height[v]
            if self.height[w] is None:
                self.parent[w], self.height[w] = f, self.height[v] + 1
                self._orient(w)
            else:
                self.low[f] = self.height[w]
            self.depth[f] = 2 * self.low[f] + (self.low2[f] < self.height[v])
            if e is not None:
                if self.low[f] < self.low[e]:
                    self.low2[e], self.low[e] = min(self.low[e], self.low2[f]), self.low[f]
                elif self.low[f] > self.low[e]:
                    self.low2[e] = min(self.low2[e], self.low[f])
                else:
                    self.low2[e] = min(self.low2[e], self.low2[f])

    def _test(self, v: int) -> bool:
        e = self.parent[v]
        for k, f in enumerate(self.out[v]):
            self.bottom[f] = self.stack[-1] if self.stack else None
            if self.parent[f[1]] == f:
                if not self._test(f[1]):
                    return False
            else:
                self.low_edge[f] = f
                p = _Pair()
                p.right = [f, f]
                self.stack.append(p)
            if self.low[f] < self.height[v]:
                if k == 0:
                    self.low_edge[e] = self.low_edge[f]
                elif not self._constrain(f, e):
                    return False
        if e is not None:
            u = e[0]
            self._trim(u)
            if self.low[e] < self.height[u] and self.stack:
                left, right = self.stack[-1].left[1], self.stack[-1].right[1]
                self.ref[e] = left if left is not None and (right is None or self.low[left] > self.low[right]) else right
        return True

    def _conflicts(self, interval: list, f: Edge) -> bool:
        return interval[1] is not None and self.low[interval[1]] > self.low[f]

    def _constrain(self, f: Edge, e: Edge) -> bool:
        p = _Pair()
        while True:  # back edges of f's subtree go to the right
            q = self.stack.pop()
            if q.left[1] is not None:
                q.swap()
            if q.left[1] is not None:
                return False
            if self.low[q.right[0]] > self.low[e]:
                if p.right[1] is None:
                    p.right[1] = q.right[1]
                else:
                    self.ref[p.right[0]] = q.right[1]
                p.right[0] = q.right[0]
            else:
                self.ref[q.right[0]] = self.low_edge[e]
            if (self.stack[-1] if self.stack else None) is self.bottom[f]:
                break
        while self.stack and (self._conflicts(self.stack[-1].left, f) or self._conflicts(self.stack[-1].right, f)):
            q = self.stack.pop()  # earlier ones that conflict go to the left
            if self._conflicts(q.right, f):
                q.swap()
            if self._conflicts(q.right, f):
                return False
            if p.right[0] is not None:
                self.ref[p.right[0]] = q.right[1]
            if q.right[0] is not None:
                p.right[0] = q.right[0]
                if p.right[1] is None:
                    p.right[1] = q.right[1]
            if p.left[1] is None:
                p.left[1] = q.left[1]
            else:
                self.ref[p.left[0]] = q.left[1]
            p.left[0] = q.left[0]
        if p.left[1] is not None or p.right[1] is not None:
            self.stack.append(p)
        return True

    def _lowest(self, p: _Pair) -> int:
        ends = [self.low[i[0]] for i in (p.left, p.right) if i[0] is not None]
        return min(ends)

    def _trim(self, u: int) -> None:
        while self.stack and self._lowest(self.stack[-1]) == self.height[u]:
            self.stack.pop()
        if not self.stack:
            return
        p = self.stack.pop()
        for mine, other in ((p.left, p.right), (p.right, p.left)):
            while mine[1] is not None and mine[1][1] == u:
                mine[1] = self.ref.get(mine[1])
            if mine[1] is None and mine[0] is not None:
                self.ref[mine[0]] = other[0]
                mine[0] = None
        self.stack.append(p)


def is_planar(neighbours: list[list[int]]) -> bool:
    return LeftRight(neighbours).planar()


def filtered_edges(n: int, pairs: Iterable[Edge], share: float = 2.7, sparse: int = 0) -> Iterator[tuple]:
    """Those of the ordered ``pairs`` (i, j, ...) that keep the graph planar, up to ``share`` of (n - 2 - sparse)."""
    budget = int(share * max(0, n - 2 - sparse))
    near: list[list[int]] = [[] for _ in range(n)]
    part = list(range(n))

    def find(a: int) -> int:
        while part[a] != a:
            part[a] = part[part[a]]
            a = part[a]
        return a

    found = 0
    for pair in pairs if budget else ():
        i, j = pair[:2]
        near[i].append(j)
        near[j].append(i)
        a, b = find(i), find(j)
        if a != b:  # a bridge never spoils planarity
            part[a] = b
        elif not is_planar(near):
            near[i].pop()
            near[j].pop()
            continue
        yield pair
        found += 1
        if found >= budget:
            break


def filtered_graph(rho: np.ndarray, share: float = 2.7, sparse: int = 0) -> list[Edge]:
    """Edges by descending correlation that keep the graph planar, up to ``share`` of (N - 2 - sparse)."""
    return list(filtered_edges(len(rho), map(tuple, _ordered_pairs(rho).tolist()), share, sparse))
