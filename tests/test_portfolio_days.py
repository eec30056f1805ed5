"""Portfolios hold one date at a time."""

import numpy as np
import pandas as pd

from quantloom.operators import optimize as O
from quantloom.operators.optimize import by_keys
from quantloom.plans.registry import QUERIES


def test_runs_of_rows_cross_batches():
    rows = pd.DataFrame({"s": [0, 0, 0, 0, 1, 1], "d": [1, 1, 2, 2, 2, 3], "x": range(6)})
    want = [[0, 1], [2, 3], [4], [5]]
    for size in (1, 2, 3, 6):
        got = by_keys((rows.iloc[i : i + size] for i in range(0, 6, size)), ["s", "d"])
        assert [d["x"].tolist() for d in got] == want


def test_no_task_gathers_a_scenario(spark):
    from quantloom.plans import model_queries  # noqa: F401  registers the query

    plan = QUERIES["qp4"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "CoGroups" not in plan.split("InMemoryRelation")[0]


def test_a_hopeless_turnover_is_known_without_solving(monkeypatch):
    """Names that left took half of the weight with them: no bands help, and only the turnover's steps that can hold are solved."""
    rng = np.random.default_rng(0)
    n, solved, descend = 60, [], O.descend
    bench, prev = np.full(n, 1 / n), rng.random(n)
    day = O.Day(rng.normal(size=n), O.Factored(rng.normal(size=(n, 3)), np.ones(n)), rng.normal(size=(n, 2)), np.eye(3)[rng.integers(0, 3, n)], bench, 0.5 * prev / prev.sum())
    limits = O.Limits(turnover=0.6)
    want = O.relaxed(day, limits, 1, solve=lambda *a: O.problem(*a))
    monkeypatch.setattr(O, "descend", lambda *a: solved.append(1) or descend(*a))
    got = O.relaxed(day, limits, 1)
    assert got[1] == want[1] == "turnover" and np.array_equal(got[0], want[0])
    assert len(solved) <= 3
