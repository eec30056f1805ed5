"""Every panel query that SQL can express, against DuckDB on the smallest tables."""

import math
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def registered():
    from quantloom.plans import artifact_queries, backtest_queries, evaluation_queries, factor_queries, model_queries, panel_queries, record_queries, store_queries  # noqa: F401
    from quantloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


LARGER = {"adjusted_idio": "/root/testdata/sf0.01"}  # ten tickers leave its regressions rank-deficient


@pytest.fixture(scope="module")
def con():
    def connected(sf):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return c

    return {sf: connected(sf) for sf in {SF, *LARGER.values()}}


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registered()[1]))
def test_query_equals_sql(spark, con, name):
    queries, oracles = registered()
    sf = LARGER.get(name, SF)
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con[sf].execute(oracles[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_entry_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True)
    n, subset = out.stdout.split()[-2:]
    assert int(n) >= 130 and subset == "True"
