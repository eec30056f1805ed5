"""Windows of many tickers without their matrix: strips of rows give what one matrix gives."""

import tracemalloc

import numpy as np
import pytest

from quantloom.operators import graph as G
from quantloom.operators import strips as S
from quantloom.operators.planar import filtered_graph

WINDOWS = [(0, 0, 35), (1, 12, 47)]


def values(n=90, t=48, gaps=0.04, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, t)) + rng.normal(size=(n, 4)) @ rng.normal(size=(4, t))
    x[rng.random(x.shape) < gaps] = np.nan
    x[7, 5:] = np.nan  # too few dates with any other
    x[8] = 1.0
    return x


@pytest.fixture(scope="module")
def panel(spark):
    x = values()
    return spark.createDataFrame([(f"{i:06d}", d, None if np.isnan(v) else float(v)) for i, r in enumerate(x) for d, v in enumerate(r)], "ticker string, date_idx int, ret double").cache()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("method", ["filtered", "louvain", "pmfg_node2vec"])
def test_clusterings(panel, method, monkeypatch):
    """the labels of one matrix, without it."""
    monkeypatch.setattr(S, "STRIP", 700)
    want = rows(G.clustered(panel, WINDOWS, method, 5, 12))
    assert rows(G.by_strips(panel, WINDOWS, method, 5, 12)) == want
    assert len({r[2] for r in want}) > 1


@pytest.mark.parametrize("whole", [0, 20, 60])
def test_linkage_by_chains(whole, monkeypatch):
    monkeypatch.setattr(S, "STRIP", 700)
    x = values()
    rho, m = S.Strips(x, 12), G.correlation_matrix(x.T, 12)
    u = S.filtered_factors(rho)
    assert list(S.linked(rho, u, 5, whole)) == list(G.complete_linkage(G.random_matrix_filter(m, x.shape[1]), 5))


def test_planar_edges(panel):
    """F11, and F9 on its graph."""
    assert rows(G.by_strips(panel, WINDOWS, "edges", 0, 12)) == rows(G.window_graph(panel, WINDOWS, "pmfg", 12))
    rho = G.correlation_matrix(values(gaps=0).T, 12)
    near, adjacency = [[] for _ in rho], np.zeros(rho.shape)
    for i, j in filtered_graph(rho):
        near[i].append(j)
        near[j].append(i)
        adjacency[i, j] = adjacency[j, i] = 1
    got, want = S.sparse_spectral(near, 4, 1), G.spectral(adjacency, 4, 1)
    assert len(set(zip(got, want, strict=True))) == len(set(want))


def test_order_in_bands():
    x = values(40)
    x[30:] = x[:10]
    rho = S.Strips(x, 12)
    got = list(S.ordered_pairs(rho, most=50, bins=256))
    whole = np.array([rho(np.array([i]))[0] for i in range(40)])
    assert [g[:2] for g in got] == [tuple(p) for p in G._ordered_pairs(whole).tolist()]


def test_no_eigenvalue_above_the_bound():
    rho = S.Strips(values(20, gaps=0), 12)
    d = np.zeros((20, 20)) + np.eye(20)
    assert list(S.linked(rho, np.zeros((20, 0)), 5)) == list(G.complete_linkage(d, 5))


def test_memory_is_not_that_of_a_matrix(monkeypatch):
    monkeypatch.setattr(S, "STRIP", 100_000)
    x = values(1500, 36, 0.002)
    tracemalloc.start()
    rho = S.Strips(x, 12)
    S.filtered_factors(rho)
    next(S.ordered_pairs(rho, most=10_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 1500 * 8
