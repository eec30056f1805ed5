"""Windows of many tickers: blocks of tickers give what one matrix gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import graph as G

WINDOWS = [(0, 0, 35), (1, 12, 47)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    common, x = rng.normal(size=(48, 4)), rng.normal(size=(60, 48))
    x += rng.normal(size=(60, 4)) @ common.T
    x[50:55] = x[:5]  # copies
    x[rng.random(x.shape) < 0.1] = np.nan
    x[55:58] = x[10:13]
    rows = [(f"{i:06d}", d, None if np.isnan(x[i, d]) else float(x[i, d])) for i in range(60) for d in range(48)]
    return spark.createDataFrame(rows, "ticker string, date_idx int, ret double").cache()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_spanning_tree_by_blocks(panel):
    whole = G.window_graph(panel, WINDOWS, "mst", 12)
    tree = {(w, min(a, b), max(a, b)) for w, a, b, _ in rows(whole)}
    blocks = rows(G.spanning_edges(panel, WINDOWS, 12, 60, block=8))
    assert {r[:3] for r in blocks} == tree and len(blocks) == 2 * 59


def test_complete_linkage_by_blocks(panel):
    whole = G.clustered(panel, WINDOWS, "complete", 5, 12)
    for clusters in (6, 30):
        assert rows(G.complete_by_blocks(G.window_rows(panel, WINDOWS), 60, 5, 12, block=8, whole=clusters)) == rows(whole)


def same(x, y):
    """Whether labels are the same up to their numbers."""
    return len(set(zip(x, y, strict=True))) == len(set(x)) == len(set(y))


def test_tree_methods_without_matrices(panel, monkeypatch):
    tickers = G.window_cells(panel, WINDOWS).select("window_id", "ticker").distinct()
    edges = G.spanning_edges(panel, WINDOWS, 12, 60, block=8)
    for method in ("spectral", "node2vec", "sub2vec"):
        assert rows(G.tree_clustered(tickers, edges, method, 5)) == rows(G.clustered(panel, WINDOWS, method, 5, 12))
    rng, near = np.random.default_rng(4), [[] for _ in range(150)]
    for i in range(1, 150):
        j = int(rng.integers(max(0, i - 6), i))
        near[i].append(j)
        near[j].append(i)
    adjacency = np.zeros((150, 150))
    for i, x in enumerate(near):
        adjacency[i, x] = 1
    for k in (3, 5, 8):
        assert same(G.forest_spectral(near, k, 1), G.spectral(adjacency, k, 1))
    u = G.embedded(G.walks(near), 150)
    v = G.sparse_embedded(G.walks(near), 150)
    assert np.allclose(((u[:, None] - u) ** 2).sum(2), ((v[:, None] - v) ** 2).sum(2), atol=1e-6)


def test_sums_of_copies_are_equal(spark):
    """two suppliers with the same lines in another order have the same mean price, so that rank_first goes by ticker."""
    from quantloom.sources.panel import month_cells

    prices = [0.1, 1e9, 0.2, 3e8 + 0.7, 0.3, 12345.67]
    rows = [(s, o, o, o, 1.0, p) for s, seq in ((1, prices), (2, prices[::-1])) for o, p in enumerate(seq)]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").withColumn("l_shipdate", F.lit("1998-01-05").cast("timestamp"))
    assert month_cells(lines.coalesce(1)).select("vwap").distinct().count() == 1
    odd = lines.withColumn("l_extendedprice", F.when(F.col("l_suppkey") == 1, F.col("l_extendedprice")).otherwise(F.lit(float("nan"))))
    assert {r[0]: np.isnan(r[1]) for r in month_cells(odd).select("ticker", "value").collect()} == {"000001": False, "000002": True}


def test_two_hops_make_no_rows_of_paths(spark):
    """many paths between few nodes, in several blocks."""
    rng = np.random.default_rng(5)
    near = np.triu(rng.random((40, 40)) < 0.15, 1)
    near |= near.T
    far = (near.astype(int) @ near > 0) & ~near & ~np.eye(40, dtype=bool)
    edges = spark.createDataFrame([(f"{i:03d}", f"{j:03d}") for i, j in zip(*np.nonzero(np.triu(near)), strict=True)], "a string, b string")
    got = G.two_hops(edges, 40, block=10)
    assert rows(got) == sorted((f"{i:03d}", f"{j:03d}") for i, j in zip(*np.nonzero(far), strict=True))
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_below_a_bound_are_never_rows(panel):
    """The same pairs as by a filter on all of them, and no filter is left to the plan."""
    every = {(r.a, r.b, r.n, round(r.rho, 9)) for r in G.correlations(panel, 30).where("abs(rho) > 0.3").collect()}
    got = G.correlations(panel, 30, beyond=0.3, block=20)
    assert {(r.a, r.b, r.n, round(r.rho, 9)) for r in got.collect()} == every and 0 < len(every) < G.correlations(panel, 30).count()


def test_residual_variances_run_each_step_once(spark):
    """Residuals are estimated once, however many steps read them."""
    from pyspark.sql import functions as F

    from quantloom.operators import risk

    cells = spark.range(40 * 30).selectExpr("lpad(cast(id % 40 as string), 6, '0') ticker", "cast(id div 40 as int) date_idx", "date_add(date'2020-01-01', cast(id div 40 as int)) trade_date", "cast(sin(id * id) as double) ret", "cast(1 + id % 7 as double) cap", "cast(cos(id) as double) a", "cast(sin(3 * id) as double) b")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def estimated(x):
        seen.add(1)
        return x

    got = risk.adjusted_idio(cells.select("ticker", "trade_date", "date_idx", estimated(F.col("ret") * 0.5).alias("value")), cells, ["a", "b"], "cap", "ret", 12, 6, 6, 2, (10, 5), True, (6, 3))
    assert got.where("idio > 0").count() == 40 * 25
    assert seen.value == 40 * 30


def test_weighted_sums_go_on_across_batches_and_tickers(spark):
    """Batches that cut a ticker's rows, nulls, and a ticker without name: as by one frame at a time."""
    import numpy as np

    from quantloom.operators import risk

    rng, h, lags, half = np.random.default_rng(4), 7, 3, 3.0
    x = {t: [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=n)] for t, n in (("a", 1), ("b", 25), ("c", 6), (None, 13))}
    rows = [(t, i, v) for t, values in x.items() for i, v in enumerate(values)]
    data = spark.createDataFrame(rows, "ticker string, date_idx int, value double").selectExpr("*", "date_add(date'2020-01-01', date_idx) trade_date")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.ticker, r.date_idx): r["var"] for r in risk.idio_newey_west(data, h, half, 3, lags).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    w = risk.ew_weights(h, half)
    for t, values in x.items():
        for i in range(len(values)):
            frame = np.array([np.nan] * max(0, h - 1 - i) + [np.nan if v is None else v for v in values[max(0, i - h + 1) : i + 1]])
            n = np.count_nonzero(~np.isnan(frame))
            if n < 3:
                assert got[t, i] is None
                continue
            z = np.nan_to_num(frame - np.nansum(w * frame) / n)
            want = (w * z * z).sum() + sum(2 * (1 - k / (lags + 1)) * (w[k:] * z[k:] * z[:-k]).sum() for k in range(1, lags + 1))
            assert abs(got[t, i] - max(want, 0)) < 1e-12


def test_many_tickers_go_to_few_blocks(spark, panel):
    """of 60,000 tickers each was sent to 61 blocks of pairs or 30 of trees; tiles of larger blocks give the same."""
    assert all(60_000 / G.block_size(60_000, *sizes) <= 17 for sizes in ((500, 8000), (2000, 16_000)))
    for ranks in (False, True):
        whole = {(r.a, r.b, r.n): r.rho for r in G.correlations(panel, 30, ranks=ranks).collect()}
        got = {(r.a, r.b, r.n): r.rho for r in G.correlations(panel, 30, ranks=ranks, block=25, tile=7).collect()}
        assert whole.keys() == got.keys() and all((v is None) == (got[k] is None) and (v is None or abs(v - got[k]) < 1e-9) for k, v in whole.items())
    trees = [sorted((r.window_id, r.a, r.b, round(r.rho, 9)) for r in G.spanning_edges(panel, WINDOWS, 12, 60, block=block, tile=tile).collect()) for block, tile in ((60, 60), (25, 7))]
    assert trees[0] == trees[1] and trees[0]
    one = {(w, min(a, b), max(a, b)) for w, a, b, _ in rows(G.window_graph(panel, WINDOWS, "mst", 12))}
    assert {r[:3] for r in trees[0]} == one  # a single block joined trees by edges that were the best at one end only


def test_neighbours_as_bytes_of_distances():
    """a neighbour takes a byte or two where numbers are near, however many nodes there are."""
    runs = [np.array(x) for x in ([0], [254, 255, 256, 1000], [5, 70_000], [509, 510, 765])]
    data, at = G.gaps(np.concatenate(runs), np.array([0, 1, 5, 7]))
    assert all((G.from_gaps(data[lo:hi].tobytes()) == x).all() for lo, hi, x in zip(at, [*at[1:], len(data)], runs, strict=True))
    near = np.flatnonzero(np.random.default_rng(1).random(60_000) < 0.026)
    assert len(G.gaps(near, np.array([0]))[0]) < 1.1 * len(near)


def test_two_hops_of_no_edges(spark):
    assert G.two_hops(spark.createDataFrame([], "a string, b string"), 40).collect() == []
