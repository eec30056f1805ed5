import itertools

import numpy as np

from quantloom.operators.planar import filtered_graph, is_planar


def graph(n, edges):
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    return near


def embeds(n, edges):
    """Planarity by Wagner's theorem: contracting and deleting never gives K5 or K3,3. For few nodes."""
    seen = set()

    def search(n, edges):
        key = (n, frozenset(edges))
        if key in seen:
            return False
        seen.add(key)
        if n == 5 and len(edges) == 10:
            return True
        if n == 6 and len(edges) >= 9:
            for left in itertools.combinations(range(6), 3):
                if all((min(a, b), max(a, b)) in edges for a in left for b in set(range(6)) - set(left)):
                    return True
        if n <= 5:
            return False
        for a, b in edges:
            name = {v: (min(a, b) if v == max(a, b) else v) for v in range(n)}
            order = {v: k for k, v in enumerate(sorted(set(name.values())))}
            new = frozenset((min(x, y), max(x, y)) for x, y in ((order[name[p]], order[name[q]]) for p, q in edges) if x != y)
            if search(n - 1, new):
                return True
        return False

    return not search(n, frozenset(edges))


def test_known_graphs():
    k5 = list(itertools.combinations(range(5), 2))
    k33 = [(a, b) for a in range(3) for b in range(3, 6)]
    assert not is_planar(graph(5, k5)) and not is_planar(graph(6, k33))
    assert is_planar(graph(5, k5[1:])) and is_planar(graph(6, k33[1:]))
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    assert not is_planar(graph(10, petersen))
    grid = [(8 * r + c, 8 * r + c + 1) for r in range(8) for c in range(7)] + [(8 * r + c, 8 * r + c + 8) for r in range(7) for c in range(8)]
    assert is_planar(graph(64, grid)) and not is_planar(graph(64, [*grid, (0, 36), (7, 28), (56, 27)]))
    apex = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)] + [(29, 1)]
    assert is_planar(graph(30, apex))


def test_random_graphs_against_minors():
    rng = np.random.default_rng(1)
    kinds = set()
    for _ in range(150):
        n = int(rng.integers(5, 8))
        pairs = list(itertools.combinations(range(n), 2))
        m = int(rng.integers(n, min(len(pairs), 3 * n - 5)))
        edges = [pairs[i] for i in sorted(rng.choice(len(pairs), m, replace=False))]
        got = is_planar(graph(n, edges))
        assert got == embeds(n, edges), (n, edges)
        kinds.add(got)
    assert kinds == {True, False}


def test_filtered_graph_is_planar_and_holds_the_tree():
    from quantloom.operators.graph import spanning_tree

    rho = np.corrcoef(np.random.default_rng(0).normal(size=(25, 40)))
    edges = filtered_graph(rho)
    assert len(edges) <= 2.7 * 23 and is_planar(graph(25, edges))
    assert set(spanning_tree(rho)) <= set(edges)
