"""Queries and targets from the command line.

python -m quantloom.cli list
python -m quantloom.cli QUERY SF_DIR [OUT]            show a query's rows, or write them as Parquet
python -m quantloom.cli run TARGET SF_DIR OUT [...]   write all results of a target, each in a folder of its own

A target is a step of the research: factors, their tests, models, risk, portfolios, clusters. Dates given to
a target cut its results; what a result looks back on is not cut.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The queries of each target.
TARGETS: dict[str, tuple[str, ...]] = {
    "gen": ("fac_registry", "fac_reversal", "fac_momentum", "fac_volatility", "fac_turnover", "fac_weighted_momentum"),
    "gen_risk": ("fac_size", "fac_nonlinear_size", "fac_capm", "fac_class_merge", "class_factors_kept"),
    "backtest_factor": ("ic", "rank_ic", "ic_stats", "ic_decay", "perf_stats", "group_test", "decay_grid", "lead_lag_grid", "split_grid", "long_short_curve", "factor_record"),
    "backtest_signal": ("port_ret", "holding_stats", "holding_ratios", "signal_curves", "path_annual", "signal_record"),
    "comb": ("clean_matrix", "predictions_loaded", "coefficients_kept", "model_metrics", "feature_importance", "cv_grid"),
    "opt_fac_ret": ("returns_kept", "idio_aligned"),
    "opt_cov_est": ("ew_factor_cov", "adjusted_cov", "adjusted_idio", "cov_asof"),
    "opt_weight": ("qp{method}",),
    "cluster_train": ("{graph}", "cluster_{clustering}"),
    "pairs": ("pair_corr", "pair_spearman", "asset_graph", "k_hop"),
}
METHODS = ("1", "2", "3", "4")
GRAPHS = {"AG": "asset_graph", "MST": "mst_edges", "PMFG": "pmfg_edges"}
CLUSTERINGS = ("complete", "filtered", "spectral", "node2vec", "sub2vec", "louvain", "pmfg_spectral", "pmfg_node2vec")


@dataclass(frozen=True)
class Options:
    start: str | None = None
    end: str | None = None
    method: str = "1"
    graph: str = "AG"
    clustering: str = "complete"

    def names(self, target: str) -> list[str]:
        return [q.format(method=self.method, graph=GRAPHS[self.graph], clustering=self.clustering) for q in TARGETS[target]]

    def cut(self, df: DataFrame) -> DataFrame:
        """Rows of the dates asked for; results without dates are whole."""
        if "trade_date" not in df.columns:
            return df
        for bound, keep in ((self.start, F.col("trade_date") >= F.lit(self.start).cast("date")), (self.end, F.col("trade_date") <= F.lit(self.end).cast("date"))):
            df = df if bound is None else df.where(keep)
        return df


def registered() -> dict:
    from .plans import artifact_queries, backtest_queries, evaluation_queries, factor_queries, model_queries, panel_queries, record_queries, store_queries  # noqa: F401  they register themselves
    from .plans.registry import QUERIES

    return QUERIES


def run_target(spark: SparkSession, target: str, sf_dir: str, out: str, options: Options = Options()) -> list[str]:
    """Write each result of a target under ``out``; the names of what was written. A query that fails ends the run, what was written before it stays."""
    queries, done = registered(), []
    for name in options.names(target):
        options.cut(queries[name](spark, sf_dir)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{target}/{name}")
        done.append(name)
    return done


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    session = lambda name: spark or SparkSession.builder.appName(f"quantloom-{name}").getOrCreate()
    if args[:1] == ["run"]:
        p = argparse.ArgumentParser(prog="quantloom run")
        p.add_argument("target", choices=sorted(TARGETS))
        p.add_argument("sf_dir")
        p.add_argument("out")
        p.add_argument("--start", help="first date, yyyy-mm-dd")
        p.add_argument("--end", help="last date, yyyy-mm-dd")
        p.add_argument("--method", choices=METHODS, default="1", help="objective of opt_weight")
        p.add_argument("--graph", choices=sorted(GRAPHS), default="AG", help="graph of cluster_train")
        p.add_argument("--clustering", choices=CLUSTERINGS, default="complete", help="method of cluster_train")
        a = p.parse_args(args[1:])
        print("\n".join(run_target(session(a.target), a.target, a.sf_dir, a.out, Options(a.start, a.end, a.method, a.graph, a.clustering))))
        return 0
    p = argparse.ArgumentParser(prog="quantloom")
    p.add_argument("query", help="a name, or 'list'")
    p.add_argument("sf_dir", nargs="?")
    p.add_argument("out", nargs="?")
    a = p.parse_args(args)
    queries = registered()
    if a.query == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.query not in queries or not a.sf_dir:
        p.error(f"no query {a.query}" if a.query not in queries else "sf_dir is needed")
    df = queries[a.query](session(a.query), a.sf_dir)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
