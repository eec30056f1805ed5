"""Numerical kernels against plain numpy, and invariants."""

import numpy as np
import pytest

from quantloom.operators import graph as G
from quantloom.operators import optimize as O
from quantloom.operators import regress as R
from quantloom.operators import risk as K
from quantloom.operators.calendar import walk_forward

rng = np.random.default_rng(0)


def test_weighted_least_squares_residuals_are_orthogonal():
    x, y, w = rng.normal(size=(50, 3)), rng.normal(size=50), rng.uniform(1, 2, 50)
    b = R.solve(x, y, w)
    assert np.allclose((x * w[:, None]).T @ (y - x @ b), 0)
    doubled = np.hstack([x, x[:, :1]])
    assert np.allclose(doubled @ R.solve(doubled, y, w), x @ b)


def test_newey_west_and_eigen_adjustment():
    x, w = rng.normal(size=(240, 4)), K.ew_weights(240, 90)
    plain = K.newey_west(x, w, 0, scalar_mean=False)
    z = x - w @ x
    assert np.allclose(plain, (z * w[:, None]).T @ z) and np.isclose(w.sum(), 1)
    cov = K.newey_west(x, w, 3)
    assert np.allclose(cov, cov.T)
    adjusted = K.eigen_adjusted(plain, 240, 20)
    assert np.allclose(adjusted, adjusted.T) and np.linalg.eigvalsh(adjusted).min() > 0


def test_asset_covariance_fills_gaps():
    got = K.asset_covariance(np.array([[1.0, np.nan], [0, 1]]), np.eye(2), np.array([0.5, np.nan]))
    assert np.allclose(got, [[1.5, 0], [0, 1.5]])


def test_interior_point_on_a_known_problem():
    # min (x1 - 1)^2 + (x2 - 3)^2 with x1 + x2 <= 2, -x1 + 2 x2 <= 2, 2 x1 + x2 <= 3: the first two bind
    x = O.interior_point(np.eye(2) * 2, np.array([-2.0, -6.0]), np.array([[1.0, 1], [-1, 2], [2, 1]]), np.array([2.0, 2, 3]), np.zeros((0, 2)), np.zeros(0))
    assert np.allclose(x, [2 / 3, 4 / 3], atol=1e-5)


def test_minimum_variance_in_closed_form():
    cov = np.diag(rng.uniform(0.01, 0.05, 12)) + 0.01
    day = O.Day(np.zeros(12), cov, np.zeros((12, 0)), np.zeros((12, 0)), np.full(12, 1 / 12), None)
    w = O.problem(day, O.Limits(upper=1.0), 1)
    want = np.linalg.solve(cov, np.ones(12))
    assert np.allclose(w, want / want.sum(), atol=1e-5)


@pytest.mark.parametrize("traded", [False, True])
def test_the_structured_system_equals_the_dense_one(traded):
    n, k = 9, 3
    width = 2 * n if traded else n
    diag, load, rows = rng.uniform(0.1, 1, n), rng.normal(size=(n, k)), rng.normal(size=(4, width))
    form = O.Portfolio(diag, load, rows, traded)
    quad = np.stack([form.quad(e) for e in np.eye(width)], axis=1)
    g = np.stack([form.bound(e) for e in np.eye(width)], axis=1)
    assert np.allclose(quad[:n, :n], np.diag(diag) + load @ load.T)
    dense = O.Dense(quad, g, form.a)
    w, r = rng.uniform(0.1, 10, len(g)), rng.normal(size=width)
    assert np.allclose(form.back(w), dense.back(w))
    assert np.allclose(form.solver(w)(r), dense.solver(w)(r), atol=1e-8)


@pytest.mark.parametrize("method", [1, 2, 3, 4])
def test_no_small_move_improves_a_portfolio(method):
    n = 30
    x, one = rng.normal(size=(n, 2)), (np.arange(n)[:, None] % 3 == np.arange(3)).astype(float)
    cov = O.Factored(np.hstack([x, one]) * 0.05, rng.uniform(0.01, 0.05, n))
    bench = rng.uniform(0.5, 1.5, n)
    bench /= bench.sum()
    day, limits = O.Day(rng.normal(size=n) * 0.02, cov, x, one, bench, rng.permutation(bench)), O.Limits(upper=0.2, style=0.2, industry=0.1, turnover=0.6)
    w = O.problem(day, limits, method)
    full = cov.load @ cov.load.T + np.diag(cov.own)
    rest = day.alpha - x @ (np.linalg.pinv(x) @ day.alpha)

    def cost(v):
        own = v @ full @ v - v @ day.alpha
        more = {1: 0, 2: 0, 3: limits.exposure * ((x.T @ v) ** 2).sum(), 4: limits.misaligned * (rest @ v) ** 2}[method]
        return own + more + (limits.trade * np.abs(v - day.prev).sum() if method > 1 else 0)

    def allowed(v):
        fine = v.min() >= 0 and v.max() <= limits.upper and np.abs(one.T @ (v - bench)).max() <= limits.industry
        return fine and (method == 3 or np.abs(x.T @ (v - bench)).max() <= limits.style) and (method > 1 or np.abs(v - day.prev).sum() <= limits.turnover)

    for _ in range(4000):  # moves between pairs and among all names
        d = rng.normal(size=n) * (rng.random(n) < rng.choice([0.1, 1.0]))
        v = w + rng.choice([1e-2, 1e-3]) * (d - (d != 0) * d.sum() / max(1, (d != 0).sum()))
        if allowed(v):
            assert cost(v) >= cost(w) - 1e-7


@pytest.mark.parametrize("method", [1, 2, 3, 4])
def test_portfolios_keep_their_limits(method):
    n = 20
    one = np.eye(4)[np.arange(n) % 4]
    bench = np.full(n, 1 / n)
    day = O.Day(rng.normal(size=n) * 0.01, np.diag(rng.uniform(0.01, 0.05, n)), rng.normal(size=(n, 2)), one, bench, bench)
    limits = O.Limits(upper=0.2, style=0.2, industry=0.1, turnover=0.4)
    w, note = O.relaxed(day, limits, method)
    assert note == "none" and np.isclose(w.sum(), 1) and w.min() >= 0 and w.max() <= 0.2 + 1e-5
    assert np.abs(one.T @ (w - bench)).max() <= 0.1 + 1e-5
    if method != 3:
        assert np.abs(day.style.T @ (w - bench)).max() <= 0.2 + 1e-5
    if method == 1:
        assert np.abs(w - bench).sum() <= 0.4 + 1e-5


def test_relaxation_gives_up_in_the_end():
    calls = []
    day = O.Day(np.zeros(2), np.eye(2), np.zeros((2, 0)), np.zeros((2, 0)), np.full(2, 0.5), None)
    w, note = O.relaxed(day, O.Limits(), 1, lambda d, lim, m: calls.append(lim))
    assert note == "gave up" and np.allclose(w, 0.5) and max(c.turnover for c in calls) >= 2 and max(c.style for c in calls) >= 1


def test_correlations_and_trees():
    x = rng.normal(size=(80, 6))
    x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=80)
    x[:30, 2] = np.nan
    rho = G.correlation_matrix(x, 40)
    ok = ~np.isnan(x[:, 2])
    assert np.isclose(rho[0, 2], np.corrcoef(x[ok, 0], x[ok, 2])[0, 1])
    assert np.isnan(G.correlation_matrix(x, 60)[0, 2])
    edges = G.spanning_tree(rho)
    assert len(edges) == 5 and (0, 1) in edges and len(set(G.complete_linkage(rho, 5))) == 5
    label = G.complete_linkage(rho, 5)
    assert label[0] == label[1]
    assert np.linalg.matrix_rank(G.random_matrix_filter(G.correlation_matrix(rng.normal(size=(500, 5)), 10), 500)) <= 5


def test_clusterings_find_two_cliques():
    a = np.zeros((10, 10))
    a[:5, :5] = a[5:, 5:] = 1
    np.fill_diagonal(a, 0)
    a[4, 5] = a[5, 4] = 0.1
    near = [list(np.flatnonzero(r)) for r in a]
    for label in (G.spectral(a, 2), G.louvain(a), G.node2vec(near, 2)):
        assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[9]
    assert len(G.sub2vec(near, 2)) == 10
    assert [G.degree_bucket(x) for x in (0, 0.049, 0.05, 0.2, 0.25, 0.49, 0.75, 0.99, 1)] == [0, 0, 1, 4, 5, 5, 7, 7, None]


def test_walk_forward_modes():
    rolling, growing = list(walk_forward(60, 24, 12, 12, 1)), list(walk_forward(60, 24, 12, 12, 1, "expanding"))
    assert rolling[1] == (1, 12, 35, 37, 48) and growing[1][1] == 0 and all(a[2] == b[2] for a, b in zip(rolling, growing))


def test_streaming_bars_equal_the_batch(spark, tmp_path):
    from quantloom.streaming.events import bars, event_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out = bars(event_stream(spark, str(tmp_path / "in"), events.schema, 3), late="100 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.start): r.n for r in spark.sql("select * from bars").collect()}
    from pyspark.sql import functions as F

    assert got == {(r.user_id, r.start): r.n for r in events.groupBy("user_id", F.date_trunc("day", "ts").alias("start")).agg(F.count("value").alias("n")).collect()}


def test_bisected_windows_test_their_own_tail():
    assert list(walk_forward(20, 10, 3, 5, 1, "bisect")) == [(0, 0, 6, 8, 9), (1, 5, 11, 13, 14), (2, 10, 16, 18, 19)]


def test_similar_kernels_on_long_calendars(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quantloom.functions.expr import decayed

    w = Window.orderBy("i").rowsBetween(-9, 0)
    got = spark.range(20_000).select(F.col("id").alias("i"), F.lit(1.0).alias("x")).select("i", decayed(w, 0.5 ** (1 / 5), F.col("x"))[0].alias("s")).where("i = 19999").first()
    assert abs(got.s - sum(0.5 ** (k / 5) for k in range(10))) < 1e-12


def test_a_record_has_its_columns(spark):
    from quantloom.plans import backtest_queries as Q
    from quantloom.plans.record_queries import factor_record

    sf = "/root/testdata/sf0.001"
    row = factor_record(spark, sf).first()
    assert len(row) == 51
    want = Q.perf_stats(spark, sf).where("year = 'sum'").first()
    assert abs(row.long_alpha_rtn - want.alpha_rtn) < 1e-5 and abs(row.long_turnover - want.turnover) < 1e-5
    assert row.best_alpha_rtn == max(row.long_alpha_rtn, row.short_alpha_rtn)


def test_weights_over_the_universe(spark):
    w = spark.createDataFrame([(0, "2020-01-01", "a", 0.6), (0, "2020-01-01", "b", 0.4)], "scenario int, trade_date string, ticker string, w double")
    panel = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    assert {(r.ticker, r.w) for r in O.over_universe(w, panel).collect()} == {("a", 0.6), ("b", 0.4), ("c", 0.0)}
    barred = spark.createDataFrame([("a",)], "ticker string")
    assert {(r.ticker, r.w) for r in O.over_universe(w, panel, barred).collect()} == {("a", 0.0), ("b", 1.0), ("c", 0.0)}
